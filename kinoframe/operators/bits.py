"""Where bits go: by superblock and category, by kind of coded symbol, and how large leaves are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bridges import CATEGORIES

SUPERBLOCK, UNIT = 64, 4
#: Context numbers of each category, first and last; what is in none is other. Fixed values.
CONTEXTS = {
    "partition_bits": ((0, 3), (19, 20), (24, 41)),
    "luma_mode_bits": ((4, 4), (21, 21), (53, 53), (305, 310)),
    "chroma_mode_bits": ((13, 14), (304, 304)),
    "palette_bits": ((42, 52),),
    "intrabc_bits": ((274, 282),),
    "inter_bits": ((265, 273), (283, 294)),
    "residual_bits": ((5, 12), (15, 18), (22, 23), (54, 264), (295, 303), (311, 313)),
}
#: Largest sides of the leaf classes. Fixed values.
LEAF_SIDES = (8, 16, 32, 64)


def context_category(number: Column) -> Column:
    """The category of a context number."""
    out = F.lit(CATEGORIES[-1])
    for name, ranges in CONTEXTS.items():
        for low, high in ranges:
            out = F.when(number.between(low, high), name).otherwise(out)
    return out


def symbol_category(kind: Column, data: Column) -> Column:
    """The category of a coded symbol: ctx by its context number (bits 8 to 17 of data), bypass bins (one, many) are residual, the rest is other."""
    return F.when(kind == "ctx", context_category(F.floor(data / 256) % 1024)).when(kind.isin("one", "many"), "residual_bits").otherwise(CATEGORIES[-1])


def symbol_bins(kind: Column, data: Column) -> Column:
    """How many bins a coded symbol has: the low six bits of data for many, one for other known kinds, else none."""
    return F.when(kind == "many", data % 64).when(kind.isin("ctx", "direct", "one", "end"), 1).otherwise(0).cast("long")


def attributed_bits(events: DataFrame, tiles: DataFrame) -> DataFrame:
    """A row a superblock of each tile: sums of bits by category, in all, and how many decisions and leaves.

    events: frame, tile, row_mi, col_mi (in units of 4 samples, from the tile's corner), before, after, category, leaf; bits that fall
    back count as none. tiles: frame, tile, x, y, width, height in samples. Superblocks without an event have zeros; an
    event beyond its tile's superblocks is left out.
    """
    sb = lambda c: F.floor(F.col(c) * UNIT / SUPERBLOCK)
    delta = F.greatest(F.col("after") - F.col("before"), F.lit(0))
    sums = [F.sum(F.when(F.col("category") == c, delta).otherwise(0)).alias(c) for c in CATEGORIES]
    found = events.groupBy("frame", "tile", sb("row_mi").alias("r"), sb("col_mi").alias("c")).agg(*sums, F.count("*").alias("decision_count"), F.count_if("leaf").alias("leaf_count"))
    steps = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(side) - 1) / SUPERBLOCK)))
    grid = tiles.where("width > 0 and height > 0").withColumn("r", steps("height")).withColumn("c", steps("width"))
    d = grid.join(found, ["frame", "tile", "r", "c"], "left")
    at = lambda origin, k: F.col(origin) + F.col(k) * SUPERBLOCK
    size = lambda side, k: F.least(F.lit(SUPERBLOCK), F.col(side) - F.col(k) * SUPERBLOCK)
    zero = F.lit(0).cast("long")
    named = [F.coalesce(c, zero).alias(c) for c in (*CATEGORIES, "decision_count", "leaf_count")]
    total = sum((F.coalesce(c, zero) for c in CATEGORIES[1:]), F.coalesce(CATEGORIES[0], zero)).alias("total_symbol_bits")
    return d.select("frame", "tile", F.floor(at("x", "c") / SUPERBLOCK).alias("sb_x"), F.floor(at("y", "r") / SUPERBLOCK).alias("sb_y"), at("x", "c").alias("x"), at("y", "r").alias("y"), size("width", "c").alias("width"), size("height", "r").alias("height"), *named, total)


def leaf_classes(leaves: DataFrame) -> DataFrame:
    """How many leaves (frame, width, height) of each picture have their longer side up to 8, 16, 32, 64 or beyond, and their samples."""
    side = F.greatest("width", "height")
    name = F.lit("other")
    for s in reversed(LEAF_SIDES):
        name = F.when(side <= s, str(s)).otherwise(name)
    return leaves.groupBy("frame", name.alias("side")).agg(F.count("*").alias("n"), F.sum(F.col("width") * F.col("height")).alias("samples"))
