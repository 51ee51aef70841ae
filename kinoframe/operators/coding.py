"""Prediction, quantization and mode choice on 8x8 blocks, each block a row with its 64 samples in px."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import before_in_label, previous, total

SIDE = 8


def at(values: Column | str, i: Column) -> Column:
    return F.get(values, i.cast("int"))


def places(ys: range, xs: range) -> Column:
    return F.array(*(F.lit(SIDE * y + x) for y in ys for x in xs))


def edge_predictors(blocks: DataFrame) -> DataFrame:
    """SAD of the DC, horizontal and vertical predictors from the blocks left (id - 1) and above (id - 8) in frames of 8 by 8, and the best.

    DC is the rounded mean of the edges that are there, 128 if none is; without a block to the left its edge is 129, without one
    above 127. Ties go to DC, then horizontal.
    """
    here = F.col("block_id")
    above = blocks.where(here % 64 < 56).select((here + SIDE).alias("block_id"), F.slice("px", 57, 8).alias("above"))
    left = blocks.where(here % 8 < 7).select((here + 1).alias("block_id"), F.array(*(F.col("px")[8 * y + 7] for y in range(8))).alias("left"))
    d = blocks.join(left, "block_id", "left").join(above, "block_id", "left")
    dc = F.when(F.col("left").isNotNull() & F.col("above").isNotNull(), F.floor((total("left") + total("above") + 8) / 16)).when(F.col("above").isNotNull(), F.floor((total("above") + 4) / 8)).when(F.col("left").isNotNull(), F.floor((total("left") + 4) / 8)).otherwise(128)
    flat = lambda c, v: F.coalesce(F.col(c), F.array_repeat(F.lit(v), 8))
    d = d.withColumns({"dc": dc, "left": flat("left", 129), "above": flat("above", 127)})
    sad = lambda p: total(F.transform("px", lambda v, i: F.abs(v - p(i))))
    d = d.select("block_id", "dc", sad(lambda i: F.col("dc")).alias("dc_sad"), sad(lambda i: at("left", F.floor(i / 8))).alias("h_sad"), sad(lambda i: at("above", i % 8)).alias("v_sad"))
    best = F.when((F.col("dc_sad") <= F.col("h_sad")) & (F.col("dc_sad") <= F.col("v_sad")), "dc").when(F.col("h_sad") <= F.col("v_sad"), "h").otherwise("v")
    return d.withColumn("mode", best)


def paeth(blocks: DataFrame) -> DataFrame:
    """SAD of the Paeth predictor on the inner 7x7 samples: the nearest of left, above and their corner to left + above - corner."""

    def error(i: Column) -> Column:
        here, left, above, corner = (at("px", i - k) for k in (0, 1, 8, 9))
        to_left, to_above, to_corner = F.abs(above - corner), F.abs(left - corner), F.abs(left + above - corner - corner)
        guess = F.when((to_left <= to_above) & (to_left <= to_corner), left).when(to_above <= to_corner, above).otherwise(corner)
        return F.abs(here - guess)

    return blocks.select("block_id", total(F.transform(places(range(1, 8), range(1, 8)), error)).alias("paeth_sad"))


def dpcm(blocks: DataFrame) -> DataFrame:
    """Sum of absolute differences to the sample before in the row and in the column; the cheaper direction."""
    walk = lambda ys, xs, k: total(F.transform(places(ys, xs), lambda i: F.abs(at("px", i) - at("px", i - k))))
    d = blocks.select("block_id", walk(range(8), range(1, 8), 1).alias("h_cost"), walk(range(1, 8), range(8), 8).alias("v_cost"))
    return d.withColumn("direction", F.when(F.col("h_cost") <= F.col("v_cost"), "h").otherwise("v"))


def rate_distortion(pairs: DataFrame, qps: tuple[int, ...], keep: int) -> DataFrame:
    """The `keep` quantizers of the least score of each block against ref, ties to the lower qp.

    Level: residual over step 2^(qp div 6), halves away from zero. Bits: exponential Golomb
    code of the level, positive ones first. Score: SSE + 2^(qp div 6) * bits.
    """
    d = pairs.select("block_id", F.zip_with("px", "ref", lambda a, b: a - b).alias("r"))

    def candidate(qp: int) -> Column:
        step = 1 << qp // 6
        level = lambda r: F.signum(r).cast("long") * F.floor((F.abs(r) + step // 2) / step)
        sse = total(F.transform("r", lambda r: (r - level(r) * step) * (r - level(r) * step)))
        bits = total(F.transform("r", lambda r: 2 * F.length(F.bin(2 * F.abs(level(r)) + F.when(level(r) > 0, 0).otherwise(1))) - 1))
        return F.struct((sse + step * bits).alias("score"), F.lit(qp).cast("long").alias("qp"), sse.alias("sse"), bits.alias("bits"))

    best = F.slice(F.array_sort(F.array(*map(candidate, qps))), 1, keep)
    out = d.select("block_id", F.posexplode(best).alias("rank", "c"))
    return out.select("block_id", (F.col("rank") + 1).cast("long").alias("rank"), "c.*")


def energy_split(pairs: DataFrame) -> DataFrame:
    """Residual energy of a block: all of it, the first 4x4 samples, the tail."""
    square = F.zip_with("px", "ref", lambda a, b: (a - b) * (a - b))
    head = total(F.transform(places(range(4), range(4)), lambda i: at("e", i)))
    d = pairs.select("block_id", square.alias("e")).select("block_id", total("e").alias("energy"), head.alias("head"))
    return d.withColumn("tail", F.col("energy") - F.col("head"))


def variance(blocks: DataFrame) -> DataFrame:
    """Integer variance of a block's samples, rounded down."""
    s, q = total("px"), total(F.transform("px", lambda x: x * x))
    return blocks.select("block_id", F.floor((64 * q - s * s) / 4096).alias("variance"))


def index_runs(blocks: DataFrame) -> DataFrame:
    """Runs of equal samples along the snake scan (every other row backwards)."""
    snake = F.array(*(F.lit(8 * y + (x if y % 2 == 0 else 7 - x)) for y in range(8) for x in range(8)))
    d = blocks.select("block_id", F.transform(snake, lambda i: at("px", i)).alias("s"))
    changes = F.zip_with(F.slice("s", 1, 63), F.slice("s", 2, 63), lambda a, b: (a != b).cast("long"))
    return d.select("block_id", (total(changes) + 1).alias("runs"))


def row_identity(blocks: DataFrame) -> DataFrame:
    """A digit for each row: 2 equals the row before, 1 is uniform, 0 neither."""
    row = lambda y: F.slice("px", 8 * y + 1, 8)
    uniform = lambda y: F.when(F.size(F.array_distinct(row(y))) == 1, "1").otherwise("0")
    flags = [uniform(0), *(F.when(row(y) == row(y - 1), "2").otherwise(uniform(y)) for y in range(1, 8))]
    return blocks.select("block_id", F.concat(*flags).alias("flags"))


def first_seen_palette(blocks: DataFrame, most: int) -> DataFrame:
    """Colours in order of first appearance, `most` at the most, and the samples that no colour covers."""
    d = blocks.withColumn("p", F.slice(F.array_distinct("px"), 1, most))
    return d.select("block_id", F.array_join("p", ",").alias("palette"), F.size(F.filter("px", lambda x: ~F.array_contains("p", x))).cast("long").alias("escaped"))


def placed(blocks: DataFrame, step: int | None) -> DataFrame:
    """Frame of 8x8 blocks, row, column and signature of each block: its 64 samples, in coarse steps if there is a step."""
    sig = F.transform("px", lambda x: F.floor(x / step)) if step else F.col("px")
    cell = F.col("block_id") % 64
    return blocks.select("block_id", F.floor(F.col("block_id") / 64).alias("frame"), F.floor(cell / 8).alias("row"), (cell % 8).alias("col"), sig.alias("sig"))


def motion_matches(blocks: DataFrame, step: int | None) -> DataFrame:
    """The nearest block of the same signature in the frame before, by Manhattan distance, then row and column.

    All 64 samples count, and equal blocks are not bounded, so flat areas match. A block meets one row, the places of
    its equals: a frame has 64 at most.
    """
    now = placed(blocks, step)
    places_of = now.groupBy((F.col("frame") + 1).alias("frame"), "sig").agg(F.collect_list(F.struct("row", "col")).alias("refs"))
    far = lambda r: F.abs(r["row"] - F.col("row")) + F.abs(r["col"] - F.col("col"))
    best = F.array_min(F.transform("refs", lambda r: F.struct(far(r).alias("d"), r["row"].alias("ref_row"), r["col"].alias("ref_col"))))
    d = now.join(places_of, ["frame", "sig"]).withColumn("b", best)
    return d.select("block_id", "frame", F.size("refs").cast("long").alias("candidates"), (F.col("b.ref_row") - F.col("row")).alias("mv_row"), (F.col("b.ref_col") - F.col("col")).alias("mv_col"))


def frame_modes(blocks: DataFrame, step: int | None) -> DataFrame:
    """How each frame follows from the one before: unchanged, one motion, mixed motion, partial or intra."""
    mv = motion_matches(blocks, step).groupBy("frame").agg(
        F.count("*").alias("matched"), F.count_if((F.col("mv_row") == 0) & (F.col("mv_col") == 0)).alias("still"), F.countDistinct("mv_row", "mv_col").alias("motions")
    )
    d = placed(blocks, step).groupBy("frame").agg(F.count("*").alias("n_blocks")).join(mv, "frame", "left").fillna(0, ["matched", "still", "motions"])
    whole = F.col("matched") == F.col("n_blocks")
    mode = F.when(F.col("still") == F.col("n_blocks"), "unchanged").when(whole & (F.col("motions") == 1), "motion").when(whole, "mixed").when(F.col("matched") > 0, "partial").otherwise("intra")
    return d.withColumn("mode", mode)


def frame_kinds(blocks: DataFrame, step: int | None) -> DataFrame:
    """key for the first block of a label, existing where it repeats the one before, inter else; compared on all samples, in coarse steps if there is a step."""
    d = blocks.select("block_id", "label", (F.transform("px", lambda x: F.floor(x / step)) if step else F.col("px")).alias("s"))
    return before_in_label(d, "s", "b").select("block_id", "label", F.when(F.col("b").isNull(), "key").when(F.col("b") == F.col("s"), "existing").otherwise("inter").alias("kind"))


__all__ = ["dpcm", "edge_predictors", "energy_split", "first_seen_palette", "frame_kinds", "frame_modes", "index_runs", "motion_matches", "paeth", "previous", "rate_distortion", "row_identity", "variance"]
