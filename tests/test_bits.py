"""Attributed bits, symbol classes, leaf classes and local matches by hand."""

from pyspark.sql import functions as F

from kinoframe.operators import bits as W
from kinoframe.operators import copies as M


def test_bits_by_superblock(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 0, 100, 64), (0, 1, 128, 64, 64, 70), (1, 0, 0, 0, 0, 64)], "frame long, tile long, x long, y long, width long, height long")
    rows = [(0, 0, 3, 15, 5, 9, "residual_bits", True), (0, 0, 0, 16, 9, 5, "residual_bits", False), (0, 0, 0, 17, 0, 7, "inter_bits", True), (0, 0, 16, 0, 0, 99, "inter_bits", True), (0, 1, 17, 0, 0, 3, "other_bits", False), (2, 0, 0, 0, 0, 1, "other_bits", False)]
    events = spark.createDataFrame(rows, "frame long, tile long, row_mi long, col_mi long, before long, after long, category string, leaf boolean")
    got = {(r["tile"], r["sb_x"], r["sb_y"]): r for r in W.attributed_bits(events, tiles).collect()}
    pick = lambda k: (got[k]["width"], got[k]["height"], got[k]["residual_bits"], got[k]["inter_bits"], got[k]["other_bits"], got[k]["total_symbol_bits"], got[k]["decision_count"], got[k]["leaf_count"])
    assert {k: pick(k) for k in got} == {(0, 0, 0): (64, 64, 4, 0, 0, 4, 1, 1), (0, 1, 0): (36, 64, 0, 7, 0, 7, 2, 1), (1, 2, 1): (64, 64, 0, 0, 0, 0, 0, 0), (1, 2, 2): (64, 6, 0, 0, 3, 3, 1, 0)}


def test_every_context_has_one_category(spark):
    got = {r["id"]: r["c"] for r in spark.range(320).select("id", W.context_category(F.col("id")).alias("c")).collect()}
    assert [got[i] for i in (0, 4, 13, 42, 274, 265, 71, 314)] == ["partition_bits", "luma_mode_bits", "chroma_mode_bits", "palette_bits", "intrabc_bits", "inter_bits", "residual_bits", "other_bits"]
    numbers = [n for ranges in W.CONTEXTS.values() for a, b in ranges for n in range(a, b + 1)]
    assert sorted(numbers) == list(range(314))


def test_leaf_classes(spark):
    d = spark.createDataFrame([(0, 8, 8), (0, 8, 16), (0, 64, 8), (0, 128, 8), (0, 16, 16)], "frame long, width long, height long")
    assert {r["side"]: (r["n"], r["samples"]) for r in W.leaf_classes(d).collect()} == {"8": (1, 64), "16": (2, 384), "64": (1, 512), "other": (1, 1024)}


def test_local_matches_stay_in_their_superblock(spark):
    px = {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 1, (1, 2): 1, (2, 2): 1, (3, 3): 1, (0, 7): 5, (0, 8): 5, (7, 0): 6, (8, 0): 6}
    d = spark.createDataFrame([(0, r, c, [v] * 64) for (r, c), v in px.items()], "frame long, row long, col long, px array<int>")
    got = {(r["row"], r["col"]): (r["kind"], r["bv_row"], r["bv_col"]) for r in M.local_matches(d).collect()}
    assert got == {(0, 1): ("left", 0, -8), (1, 1): ("above", -8, 0), (1, 2): ("left", 0, -8), (2, 2): ("above", -8, 0), (3, 3): ("above left", -8, -8)}
