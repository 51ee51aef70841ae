"""Areas cut out of pictures, on any sample, as blocks of their own; and the seeded sweep of areas to cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8


def drawn(seed: int, what: Column, below: Column) -> Column:
    """A number from 0 to below - 1 that hangs on the seed and a name only."""
    value = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), what).cast("binary")), 1, 8), 16, 10).cast("long")
    return value % below


def crop_sweep(pictures: DataFrame, seed: int, sides: tuple[int, ...] = tuple(range(8, 65, 8)), align_x: int = 1, align_y: int = 1) -> DataFrame:
    """One crop of every width and height in each source: crop, source, frame, x0, y0, width, height.

    pictures: source, frames, width, height. Frame and origin are drawn by seed, source and size, so they do not
    depend on how the job is cut up; origins are multiples of align. A source smaller than a side, or without frames, raises.
    """
    d = pictures.withColumns({"pw": F.col("width"), "ph": F.col("height")}).drop("width", "height")
    span = F.array(*map(F.lit, sides))
    d = d.select("*", F.explode(span).alias("width")).select("*", F.explode(span).alias("height"))
    d = d.withColumn("crop", F.concat_ws("_", F.col("source").cast("string"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))))
    small = (F.col("width") > F.col("pw")) | (F.col("height") > F.col("ph")) | (F.col("frames") < 1)
    d = d.withColumn("frame", F.when(small, F.raise_error(F.concat(F.lit("crop exceeds its source: "), F.col("crop"))).cast("long")).otherwise(drawn(seed, F.concat("crop", F.lit(":frame")), F.col("frames"))))
    origin = lambda name, most, align: (drawn(seed, F.concat("crop", F.lit(f":{name}")), F.floor(most / align) + 1) * align).alias(f"{name}0")
    return d.select("crop", "source", "frame", origin("x", F.col("pw") - F.col("width"), align_x), origin("y", F.col("ph") - F.col("height"), align_y), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def crop_blocks(blocks: DataFrame, crops: DataFrame, pictures: DataFrame) -> DataFrame:
    """The crops as blocks of their own: crop, row, col, px; a block takes its samples from up to four of the picture's.

    blocks: frame, row, col, px. crops: crop, frame, x0, y0, width, height, sides multiples of 8. pictures: frame, width, height.
    A crop that leaves its picture, or whose picture is not there or lacks a block, raises.
    """
    size = pictures.select("frame", F.col("width").alias("pw"), F.col("height").alias("ph"))
    d = crops.join(size, "frame", "left")
    good = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + F.col("width") <= F.col("pw")) & (F.col("y0") + F.col("height") <= F.col("ph")) & (F.col("width") % SIDE == 0) & (F.col("height") % SIDE == 0)
    bad = F.raise_error(F.concat(F.lit("crop leaves its picture: "), F.col("crop").cast("string"))).cast("long")
    d = d.withColumn("x0", F.when(F.coalesce(good, F.lit(False)), F.col("x0")).otherwise(bad))
    steps = lambda side: F.sequence(F.lit(0).cast("long"), F.floor(F.col(side) / SIDE) - 1)
    d = d.where("width > 0 and height > 0").select("crop", "frame", "x0", "y0", "width", F.explode(steps("height")).alias("r")).select("crop", "frame", "x0", "y0", "r", F.explode(steps("width")).alias("c"))
    d = d.withColumns({"oy": (F.col("y0") + F.col("r") * SIDE) % SIDE, "ox": (F.col("x0") + F.col("c") * SIDE) % SIDE})
    quads = [F.struct(F.lit(dy * 2 + dx).alias("q"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)]
    needed = F.filter(F.array(*quads), lambda t: ((t["dy"] == 0) | (F.col("oy") > 0)) & ((t["dx"] == 0) | (F.col("ox") > 0)))
    d = d.select("*", F.size(needed).alias("n"), F.explode(needed).alias("t"))
    place = lambda o, k, i: (F.floor((F.col(o) + F.col(k) * SIDE) / SIDE) + F.col(f"t.{i}")).alias({"r": "row", "c": "col"}[k])
    d = d.select("crop", "frame", F.col("r").alias("to_row"), F.col("c").alias("to_col"), "oy", "ox", "n", "t.q", place("y0", "r", "dy"), place("x0", "c", "dx"))
    got = d.join(blocks.select("frame", "row", "col", "px"), ["frame", "row", "col"])
    quad = lambda k: F.max(F.when(F.col("q") == k, F.col("px"))).alias(f"q{k}")
    g = d.groupBy("crop", "to_row", "to_col").agg(F.max("n").alias("n")).join(got.groupBy("crop", "to_row", "to_col").agg(F.count("*").alias("m"), F.max("oy").alias("oy"), F.max("ox").alias("ox"), *map(quad, range(4))), ["crop", "to_row", "to_col"], "left")

    def sample(i: Column) -> Column:
        y, x = F.col("oy") + F.floor(i / SIDE), F.col("ox") + i % SIDE
        at = ((y % SIDE) * SIDE + x % SIDE).cast("int")
        upper = F.when(x < SIDE, F.get("q0", at)).otherwise(F.get("q1", at))
        return F.when(y < SIDE, upper).otherwise(F.when(x < SIDE, F.get("q2", at)).otherwise(F.get("q3", at)))

    lacking = F.raise_error(F.concat(F.lit("a block is missing under crop "), F.col("crop").cast("string"))).cast("array<int>")
    px = F.when(F.col("m").eqNullSafe(F.col("n")), F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), sample)).otherwise(lacking)
    return g.select("crop", F.col("to_row").alias("row"), F.col("to_col").alias("col"), px.alias("px"))
