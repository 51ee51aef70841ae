"""Sample operators on 8x8 blocks: lifted Walsh-Hadamard pairs, DPCM pairs, prefix sums, simple regions, RGB planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import total

SIDE, FRAME_BLOCKS, STEP = 8, 64, 4
#: Limits of a simple region: distinct samples, range, distinct samples and mean gradient (1/256). Fixed values.
FEW_VALUES, SMALL_RANGE, SOME_VALUES, SMALL_GRADIENT = 8, 8, 16, 192


def named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def four(n: int, f) -> Column:
    return F.array(*(f(k) for k in range(n)))


def lift(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One lifting step of the integer Walsh-Hadamard transform, as an array (low, mid, high, rest): no rounding is lost."""

    def rest(s: Column) -> Column:
        half = F.floor((s[0] - s[1]) / 2).cast("long")
        return named(F.array(half - c, half - b), lambda t: F.array(s[0] - t[0], t[0], s[1] + t[1], t[1]))

    return named(F.array((a + b).cast("long"), (d - c).cast("long")), rest)


def unlift(v: Column) -> Column:
    """The samples (a, b, c, d) that lift made v of."""

    def rest(s: Column) -> Column:
        half = F.floor((s[0] - s[1]) / 2).cast("long")
        return named(F.array(half - v[3], half - v[1]), lambda t: F.array(s[0] - t[0], t[0], t[1], s[1] + t[1]))

    return named(F.array(v[0] + v[1], v[2] - v[3]), rest)


def wht(blocks: DataFrame) -> DataFrame:
    """A row a 4x4 quarter (block_id, quarter, samples, coefficients, restored): the transform with scale 8, and its inverse."""
    corner = lambda q: 4 * SIDE * (q // 2) + 4 * (q % 2)
    quarters = F.array(*(F.struct(F.lit(q).alias("quarter"), F.array(*(F.col("px")[corner(q) + SIDE * (i // 4) + i % 4].cast("long") for i in range(16))).alias("samples")) for q in range(4)))
    d = blocks.select("block_id", F.explode(quarters).alias("q")).select("block_id", "q.*")
    p = F.col("samples")
    d = d.withColumn("down", four(4, lambda x: lift(p[x], p[4 + x], p[8 + x], p[12 + x])))
    m = F.col("down")
    d = d.withColumn("across", four(4, lambda y: lift(m[0][y], m[1][y], m[2][y], m[3][y])))
    d = d.withColumn("coefficients", F.transform(F.flatten("across"), lambda v: v * 8)).drop("down", "across")
    c = F.transform("coefficients", lambda v: F.floor(v / 8).cast("long"))
    d = d.withColumn("c", c).withColumn("rows", four(4, lambda y: unlift(F.slice("c", 4 * y + 1, 4))))
    r = F.col("rows")
    d = d.withColumn("columns", four(4, lambda x: unlift(F.array(r[0][x], r[1][x], r[2][x], r[3][x]))))
    k = F.col("columns")
    return d.withColumn("restored", F.array(*(k[i % 4][i // 4] for i in range(16)))).drop("c", "rows", "columns")


def wht_summary(blocks: DataFrame) -> DataFrame:
    """DC, sum of |AC|, a sum of coefficients weighted by place, and whether the inverse gives the samples again."""
    c = F.col("coefficients")
    weighted = total(F.transform(c, lambda v, i: v * (i + 1)))
    return wht(blocks).select("block_id", F.col("quarter").cast("long").alias("quarter"), c[0].alias("dc"), (total(F.transform(c, F.abs)) - F.abs(c[0])).alias("ac"), weighted.alias("weighted"), (F.col("samples") == F.col("restored")).alias("lossless"))


def dpcm_pair(blocks: DataFrame) -> DataFrame:
    """Horizontal and vertical DPCM residuals (the first sample of a line as it is), their costs, and the inverse by running sums."""
    i = lambda k: k.cast("int")
    px = F.col("px")
    h = F.transform(px, lambda v, k: F.when(k % SIDE == 0, v).otherwise(v - F.get(px, i(k - 1))))
    v_ = F.transform(px, lambda v, k: F.when(k < SIDE, v).otherwise(v - F.get(px, i(k - SIDE))))
    d = blocks.select("block_id", "px", h.alias("h"), v_.alias("v"))
    line = lambda c, k, step, n: total(F.transform(F.sequence(F.lit(0), n), lambda j: F.get(F.col(c), i(k - step * j))))
    back_h = F.transform(px, lambda _, k: line("h", k, 1, i(k % SIDE)).cast("int"))
    back_v = F.transform(px, lambda _, k: line("v", k, SIDE, i(F.floor(k / SIDE))).cast("int"))
    cost = lambda c: total(F.transform(c, F.abs))
    return d.select("block_id", cost("h").alias("h_residual"), cost("v").alias("v_residual"), ((back_h == px) & (back_v == px)).alias("lossless"))


def prefix_sums(blocks: DataFrame) -> DataFrame:
    """Prefix sums of the sorted samples: their sum, and the least sum of absolute distances to one sample, the median."""
    d = blocks.select("block_id", F.sort_array("px").alias("s"))
    sums = F.expr("aggregate(s, named_struct('at', 0L, 'all', 0L), (a, x) -> named_struct('at', a.at + x, 'all', a.all + a.at + x)).all")
    return d.select("block_id", sums.alias("prefix_total"), F.col("s")[31].cast("long").alias("median"), total(F.transform("s", lambda x: F.abs(x - F.col("s")[31]))).alias("median_cost"))


def simple_regions(blocks: DataFrame) -> DataFrame:
    """For each frame of 64 blocks, on a grid of every fourth sample: distinct values, range, mean gradient to the left
    and above in 1/256, and whether the region is simple."""
    taps = F.array(*(F.struct(F.lit(y // STEP).alias("y"), F.lit(x // STEP).alias("x"), F.col("px")[SIDE * y + x].alias("v")) for y in range(0, SIDE, STEP) for x in range(0, SIDE, STEP)))
    here = F.col("block_id") % FRAME_BLOCKS
    d = blocks.select(F.floor(F.col("block_id") / FRAME_BLOCKS).alias("frame"), here.alias("b"), F.explode(taps).alias("t"))
    d = d.select("frame", (F.floor(F.col("b") / SIDE) * 2 + F.col("t.y")).alias("y"), (F.col("b") % SIDE * 2 + F.col("t.x")).alias("x"), "t.v")
    before = lambda keep, along: F.when(F.lag(along).over(w := Window.partitionBy("frame", keep).orderBy(along)) == F.col(along) - 1, F.abs(F.col("v") - F.lag("v").over(w)))
    d = d.select("frame", "v", before("y", "x").alias("left"), before("x", "y").alias("above"))
    edges, gradient = F.count("left") + F.count("above"), F.coalesce(F.sum("left"), F.lit(0)) + F.coalesce(F.sum("above"), F.lit(0))
    out = d.groupBy("frame").agg(F.countDistinct("v").alias("n_values"), (F.max("v") - F.min("v")).cast("long").alias("range"), F.when(edges == 0, 0).otherwise(F.floor(gradient * 256 / edges)).alias("gradient"))
    simple = (F.col("n_values") <= FEW_VALUES) | (F.col("range") <= SMALL_RANGE) | ((F.col("n_values") <= SOME_VALUES) & (F.col("gradient") <= SMALL_GRADIENT))
    return out.withColumn("simple", simple)


def rgb_planes(blocks: DataFrame) -> DataFrame:
    """Three blocks in a row as the R, G and B planes of a picture: packed as RGB, unpacked to G, B, R planes, and back."""
    plane = lambda k, name: blocks.where(F.col("block_id") % 3 == k).select(F.floor(F.col("block_id") / 3).alias("picture"), F.col("px").alias(name))
    d = plane(0, "r").join(plane(1, "g"), "picture").join(plane(2, "b"), "picture")
    packed = F.flatten(F.transform("r", lambda v, i: F.array(v, F.get("g", i.cast("int")), F.get("b", i.cast("int")))))
    d = d.withColumn("packed", packed)
    gather = lambda k: F.filter("packed", lambda v, i: i % 3 == k)
    d = d.withColumn("planar", F.concat(gather(1), gather(2), gather(0)))
    weighted = lambda c: total(F.transform(c, lambda v, i: v.cast("long") * (i + 1)))
    return d.select("picture", weighted("packed").alias("packed_sum"), weighted("planar").alias("planar_sum"), (F.col("planar") == F.concat("g", "b", "r")).alias("lossless"))
