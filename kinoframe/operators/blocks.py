"""Operators on 8x8 blocks of samples: errors, gradients, palettes, transforms and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXELS = 64
#: Ids of a range of a label's blocks.
RANGE = 4096


def total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def dealt(rows: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """Rows dealt by their keys over as many tasks as the session shuffles into, or over `tasks` if these are more.

    For short rows that grow later: a small file is one task, and without the number an adaptive plan joins the shuffled ones again.
    """
    return rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def previous(blocks: DataFrame, step: int = PIXELS) -> DataFrame:
    """Each block with the one `step` ids before it as ref; frames of 8 by 8 blocks: the block at its place in the frame before."""
    ref = blocks.select((F.col("block_id") + step).alias("block_id"), F.col("px").alias("ref"))
    return blocks.join(ref, "block_id")


def errors(pairs: DataFrame) -> DataFrame:
    """SAD, SSE and PSNR of each block against ref; equal blocks have no finite PSNR."""
    diff = F.zip_with("px", "ref", lambda a, b: a - b)
    d = pairs.withColumn("_d", diff).withColumns({"sad": total(F.transform("_d", F.abs)), "sse": total(F.transform("_d", lambda x: x * x))})
    psnr = F.when(F.col("sse") > 0, F.round(10 * F.log10(F.lit(255.0 * 255 * PIXELS) / F.col("sse")), 6))
    return d.select("block_id", "label", "sad", "sse", psnr.alias("psnr"))


def pooled_psnr(pairs: DataFrame) -> DataFrame:
    """PSNR by label from summed errors."""
    d = errors(pairs).groupBy("label").agg(F.count("*").alias("n"), F.sum("sse").alias("sse"))
    return d.withColumn("psnr", F.when(F.col("sse") > 0, F.round(10 * F.log10(255.0 * 255 * PIXELS * F.col("n") / F.col("sse")), 6)))


def sums(px: Column, places: list[int]) -> Column:
    """struct(s, q) of the sum of the samples at `places` and of their squares."""
    part = [px[i].cast("long") for i in places]
    return F.struct(sum(part[1:], part[0]).alias("s"), sum((x * x for x in part[1:]), part[0] * part[0]).alias("q"))


def mean_sse(part: Column, n: int) -> Column:
    """SSE of n samples of these sums around their mean, rounded half up."""
    mean = F.floor((part["s"] + n // 2) / n)
    return part["q"] - 2 * mean * part["s"] + n * mean * mean


def split_gain(blocks: DataFrame) -> DataFrame:
    """SSE around one mean against four means of the 4x4 quarters."""
    quarter = lambda oy, ox: [8 * (oy + y) + ox + x for y in range(4) for x in range(4)]
    corners = ((0, 0), (0, 4), (4, 0), (4, 4))
    d = blocks.select("block_id", *(sums(F.col("px"), quarter(*c)).alias(f"p{k}") for k, c in enumerate(corners)))
    whole = F.struct(*(sum((F.col(f"p{k}.{c}") for k in (1, 2, 3)), F.col(f"p0.{c}")).alias(c) for c in ("s", "q")))
    four = sum((mean_sse(F.col(f"p{k}"), PIXELS // 4) for k in (1, 2, 3)), mean_sse(F.col("p0"), PIXELS // 4))
    d = d.withColumn("w", whole).select("block_id", mean_sse(F.col("w"), PIXELS).alias("whole_sse"), four.alias("split_sse"))
    return d.withColumn("gain", F.col("whole_sse") - F.col("split_sse")).withColumn("side", F.when(F.col("gain") > 0, 4).otherwise(8).cast("long"))


def palettes(blocks: DataFrame) -> DataFrame:
    """Distinct samples, range, and whether 2 to 4 distinct samples make a palette of the block; the samples as they are."""
    d = blocks.select("block_id", F.size(F.array_distinct("px")).cast("long").alias("n_colours"), (F.array_max("px") - F.array_min("px")).cast("long").alias("range"))
    return d.withColumn("palette_worthy", F.col("n_colours").between(2, 4))


def histogram(blocks: DataFrame) -> DataFrame:
    """Count and first place of each sample of a label's blocks."""
    p = blocks.select("label", "block_id", F.posexplode("px").alias("at", "v"))
    return p.groupBy("label", "v").agg(F.count("*").alias("n"), F.min(F.col("block_id") * PIXELS + F.col("at")).alias("first_at")).withColumn("v", F.col("v").cast("long"))


def quantized(blocks: DataFrame, step: int) -> DataFrame:
    return blocks.withColumn("px", F.transform("px", lambda x: F.floor(x / step).cast("int")))


def rescale_depth(blocks: DataFrame, depth: int) -> DataFrame:
    """8-bit samples at another depth: (s * most + 127) div 255; sum and largest of each block."""
    most = (1 << depth) - 1
    px = F.transform("px", lambda s: F.floor((s.cast("long") * most + 127) / 255))
    return blocks.select("block_id", total(px).alias("total"), F.array_max(px).alias("largest"))


def walsh_hadamard(blocks: DataFrame) -> DataFrame:
    """The 4x4 Walsh-Hadamard transforms of each block's four quarters: sums of their DC and of their absolute AC terms."""
    return walsh_hadamard_quarters(blocks).groupBy("block_id").agg(F.sum("dc").alias("dc"), F.sum("ac").alias("ac"))


def walsh_hadamard_quarters(blocks: DataFrame) -> DataFrame:
    """The 4x4 Walsh-Hadamard transform of all four quarters of each block, a row each, in raster order from 0."""
    quarter = lambda oy, ox: F.array(*(F.col("px")[8 * (oy + y) + ox + x] for y in range(4) for x in range(4)))
    four = F.array(*(quarter(oy, ox) for oy in (0, 4) for ox in (0, 4)))
    return _walsh_terms(blocks.select("block_id", F.posexplode(four).alias("quarter", "px")).withColumn("quarter", F.col("quarter").cast("long")), ["block_id", "quarter"], 4)


def _walsh_terms(blocks: DataFrame, key: list[str], side: int) -> DataFrame:
    px = lambda y, x: F.col("px")[side * y + x].cast("long")
    sign = lambda a, b: -1 if bin(a & b).count("1") % 2 else 1
    terms = F.array(*(sum((px(y, x) * (sign(u, y) * sign(v, x)) for y in range(4) for x in range(4) if y or x), px(0, 0)) for u in range(4) for v in range(4)))
    d = blocks.select(*key, terms.alias("_t"))
    return d.select(*key, F.col("_t")[0].alias("dc"), (total(F.transform("_t", F.abs)) - F.abs(F.col("_t")[0])).alias("ac"))


def coarse_matches(blocks: DataFrame, step: int) -> DataFrame:
    """The smallest earlier block whose 64 samples are the same in coarse steps, with the distance in ids.

    Signatures are grouped, not paired: the candidate of a block is the first of its group.
    """
    d = blocks.select("block_id", F.transform("px", lambda x: F.floor(x / step)).alias("signature"))
    first = d.groupBy("signature").agg(F.min("block_id").alias("match_id"), F.count("*").alias("n"))
    return d.join(first.where("n > 1"), "signature").where("match_id < block_id").select("block_id", "match_id", (F.col("block_id") - F.col("match_id")).alias("distance"))


def block_matches(blocks: DataFrame) -> DataFrame:
    """The smallest earlier block with the same 64 samples, with the distance in ids; samples are compared, not hashes."""
    first = blocks.groupBy("px").agg(F.min("block_id").alias("match_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return blocks.join(first, "px").where("match_id < block_id").select("block_id", "match_id", (F.col("block_id") - F.col("match_id")).alias("distance"))


def before_in_label(blocks: DataFrame, value: str, name: str) -> DataFrame:
    """blocks with `name`: the value of the label's block before, by id; null for its first.

    A label is cut into ranges of ids, so that a large one is many groups; the first block of a range takes the last
    value of the nearest range before it, from a table of one row a range.
    """
    d = blocks.withColumn("_range", F.floor(F.col("block_id") / RANGE))
    last = d.groupBy("label", "_range").agg(F.max_by(value, "block_id").alias("_last"))
    edge = last.select(F.col("label").alias("_label"), F.col("_range").alias("_of"), F.lag("_last").over(Window.partitionBy("label").orderBy("_range")).alias("_edge"))
    inside = Window.partitionBy("label", "_range").orderBy("block_id")
    d = d.withColumn(name, F.lag(value).over(inside)).withColumn("_at", F.row_number().over(inside))
    d = d.join(edge, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    return d.withColumn(name, F.when(F.col("_at") == 1, F.col("_edge")).otherwise(F.col(name))).drop("_range", "_at", "_label", "_of", "_edge")


def change_runs(blocks: DataFrame) -> DataFrame:
    """Per label in id order: SAD to the label's block before, null for the first."""
    return before_in_label(blocks, "px", "ref").select("block_id", "label", total(F.zip_with("px", "ref", lambda a, b: F.abs(a - b))).alias("sad"))
