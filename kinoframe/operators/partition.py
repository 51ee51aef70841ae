"""Pictures cut into leaves: halves of halves of 64x64 superblocks, down to what their content asks for.

A superblock is one row that holds what decides over it, so every level of the tree is an expression and an
explode on leaves; six halvings lead from 64x64 to 8x8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import FEW_VALUES, SMALL_GRADIENT, SMALL_RANGE, SOME_VALUES, STEP

SUPERBLOCK, BASE, LEAST, LEVELS = 64, 16, 8, 6
#: A block of so few distinct samples, but more than one, is worth a palette and stays alone. Fixed value.
FEW_COLOURS = 4
#: Shapes (width, height) that are only cut across, only cut along, and not cut. Fixed values.
ONLY_ROWS, ONLY_COLUMNS, WHOLE = ((8, 32), (16, 64)), ((32, 8), (64, 16)), ((8, 64), (64, 8))


def features(blocks: DataFrame) -> DataFrame:
    """A row for each superblock with a visible block: frame, sb_row, sb_col, simple, small (81 counts).

    simple: on every fourth sample, few distinct values, a small range, or some values and a small mean gradient.
    small: the number of palette-worthy blocks above and left of each corner of the 8x8 grid.
    """
    colours = F.size(F.array_distinct("px"))
    taps = F.array(*(F.col("px")[LEAST * y + x] for y in range(0, LEAST, STEP) for x in range(0, LEAST, STEP)))
    d = blocks.select("frame", F.floor(F.col("row") / 8).alias("sb_row"), F.floor(F.col("col") / 8).alias("sb_col"), F.pmod("row", F.lit(8)).alias("r"), F.pmod("col", F.lit(8)).alias("c"), colours.between(2, FEW_COLOURS).alias("small"), taps.alias("taps"))
    d = d.groupBy("frame", "sb_row", "sb_col").agg(F.collect_list(F.struct("r", "c", "small", "taps")).alias("b"))
    tap = lambda t, i: F.struct((t["r"] * 2 + F.floor(i / 2)).alias("y"), (t["c"] * 2 + i % 2).alias("x"), t["taps"][i.cast("int")].alias("v"))
    grid = F.map_from_entries(F.transform(F.flatten(F.transform("b", lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: tap(t, i)))), lambda t: F.struct((t["y"] * 16 + t["x"]).alias("k"), t["v"].alias("v"))))
    d = d.withColumn("grid", grid)
    steps = lambda inside, back: F.filter(F.transform(F.map_keys("grid"), lambda k: F.when(inside(k), F.abs(F.col("grid")[k] - F.col("grid")[k - back]))), lambda v: v.isNotNull())
    d = d.withColumn("steps", F.concat(steps(lambda k: k % 16 > 0, 1), steps(lambda k: k >= 16, 16)))
    v = F.map_values("grid")
    n, span = F.size(F.array_distinct(v)), F.array_max(v) - F.array_min(v)
    gradient = F.when(F.size("steps") == 0, 0).otherwise(F.floor(F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x) * 256 / F.size("steps")))
    simple = (n <= FEW_VALUES) | (span <= SMALL_RANGE) | ((n <= SOME_VALUES) & (gradient <= SMALL_GRADIENT))
    before = lambda k: F.size(F.filter("b", lambda t: t["small"] & (t["r"] < F.floor(k / 9)) & (t["c"] < k % 9)))
    return d.select("frame", "sb_row", "sb_col", simple.alias("simple"), F.transform(F.sequence(F.lit(0), F.lit(80)), before).alias("small"))


def _is(shapes) -> str:
    return "(" + " OR ".join(f"(w = {w} AND h = {h})" for w, h in shapes) + ")"


_CORNER = "get(small, int({r} * 9 + {c}))"
_R0, _C0, _R1, _C1 = "(y % 64) div 8", "(x % 64) div 8", "((y % 64 + h) div 8)", "((x % 64 + w) div 8)"
#: How the leaf (x, y, w, h) of a picture of pw by ph is cut: h into an upper and a lower half, v into left and right ones, or n.
#: What later steps build on; palette-worthy blocks inside come from four corner counts.
_FIRST = {
    "rows_": "y + h div 2 < ph",
    "cols_": "x + w div 2 < pw",
    "horz_": f"NOT {_is(ONLY_COLUMNS)}",
    "vert_": f"NOT {_is(ONLY_ROWS)}",
    "small_": f"(w > {LEAST} OR h > {LEAST}) AND {_CORNER.format(r=_R1, c=_C1)} - {_CORNER.format(r=_R0, c=_C1)} - {_CORNER.format(r=_R1, c=_C0)} + {_CORNER.format(r=_R0, c=_C0)} > 0",
}
#: At the edge of the picture the cut is forced, where that cut is one of the shape.
_SECOND = {
    "base_": f"IF(small_, {LEAST}, {BASE})",
    "edge_": """CASE WHEN rows_ AND cols_ THEN NULL WHEN w = h THEN IF(rows_, 'v', 'h') WHEN h > w AND NOT rows_ THEN 'h' WHEN h > w AND w >= 16 AND x + w div 4 >= pw THEN 'h'
        WHEN w > h AND NOT cols_ THEN 'v' WHEN w > h AND h >= 16 AND y + h div 4 >= ph THEN 'v' END""",
}
_CUT = f"""CASE WHEN done OR {_is(WHOLE)} THEN 'n' WHEN edge_ = 'h' AND horz_ THEN 'h' WHEN edge_ = 'v' AND vert_ THEN 'v'
    WHEN NOT (rows_ AND cols_) AND horz_ AND NOT vert_ THEN 'h' WHEN NOT (rows_ AND cols_) AND vert_ AND NOT horz_ THEN 'v'
    WHEN rows_ AND cols_ AND ((w <= base_ AND h <= base_) OR (NOT small_ AND ((w <= {BASE} AND h <= {BASE}) OR simple))) THEN 'n'
    WHEN w > h AND w > base_ AND vert_ THEN 'v' WHEN h > base_ AND horz_ THEN 'h' WHEN w > base_ AND vert_ THEN 'v'
    WHEN rows_ AND cols_ THEN 'n' WHEN horz_ THEN 'h' WHEN vert_ THEN 'v' ELSE 'n' END"""
_KEPT = ("frame", "pw", "ph", "simple", "small")
_LEAF = (*_KEPT, "done", "x", "y", "w", "h")
#: The leaves that a leaf is cut into, but for those outside the picture.
_KIDS = """inline(filter(CASE cut WHEN 'h' THEN array(named_struct('x', x, 'y', y, 'w', w, 'h', h div 2), named_struct('x', x, 'y', y + h div 2, 'w', w, 'h', h div 2))
    WHEN 'v' THEN array(named_struct('x', x, 'y', y, 'w', w div 2, 'h', h), named_struct('x', x + w div 2, 'y', y, 'w', w div 2, 'h', h))
    ELSE array(named_struct('x', x, 'y', y, 'w', w, 'h', h)) END, k -> k.x < pw AND k.y < ph))"""


def _with_cut(leaves: DataFrame) -> DataFrame:
    steps = leaves
    for names in (_FIRST, _SECOND):
        steps = steps.selectExpr("*", *(f"{e} AS {name}" for name, e in names.items()))
    return steps.selectExpr(*_LEAF, f"{_CUT} AS cut")


def partition_tree(features: DataFrame, pictures: DataFrame) -> DataFrame:
    """The leaves of each picture: frame, x, y, width, height, in samples.

    features: frame, sb_row, sb_col, simple, small. pictures: frame, width, height, multiples of 8. Halves that lie
    outside their picture are left out; leaves cover the rest once. A leaf may stand out beyond the right or lower
    edge if its middle does not.
    """
    size = pictures.select("frame", F.col("width").alias("pw"), F.col("height").alias("ph"))
    d = features.join(size, "frame").selectExpr(*_KEPT, "false AS done", f"sb_col * {SUPERBLOCK} AS x", f"sb_row * {SUPERBLOCK} AS y", f"{SUPERBLOCK}L AS w", f"{SUPERBLOCK}L AS h")
    d = _with_cut(d.where("x < pw and y < ph"))
    for _ in range(LEVELS):
        d = _with_cut(d.selectExpr(*_KEPT, "cut = 'n' AS done", _KIDS))
    return d.select("frame", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
