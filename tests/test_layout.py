"""Tiles, masks, leaves and choices by hand."""

from pyspark.sql import functions as F

from kinoframe.operators import layout as L


def test_full_hd_has_four_by_two_tiles(spark):
    pictures = spark.createDataFrame([(1, 1920, 1080, 2, 1), (2, 40, 100, 3, 0)], "id long, width long, height long, log2_cols long, log2_rows long")
    got = L.tile_layout(pictures).orderBy("id", "tile_row", "tile_col").collect()
    assert [(r.x, r.width) for r in got[:4]] == [(0, 512), (512, 512), (1024, 448), (1472, 448)]
    assert [(r.y, r.height) for r in (got[0], got[4])] == [(0, 512), (512, 568)]
    # a picture of one partial superblock is one tile, however many are asked for
    assert [tuple(r) for r in got[8:]] == [(2, 0, 0, 0, 0, 40, 100)]


def test_masks_of_good_bad_and_missing_regions(spark):
    blocks = spark.createDataFrame([(i, [0] * 64) for i in range(256)], "block_id long, px array<int>")
    regions = spark.createDataFrame([(0, 8, 8, 16, 8), (0, 16, 8, 16, 8), (1, 0, 0, 0, 9), (2, 56, 0, 16, 8), (2, 3, 0, 8, 8)], "frame long, x0 long, y0 long, width long, height long")
    got = {r.frame: tuple(r)[1:] for r in L.search_mask(blocks, regions).collect()}
    assert got == {0: (2, 0, 3), 1: (1, 0, 0), 2: (2, 2, 0), 3: (0, 0, 64)}
    assert L.search_mask(blocks, regions.limit(0)).where("searched = 64").count() == 4


def test_leaves_merge_only_if_whole_and_alike(spark):
    modes = [(0, y, x, "skip") for y in range(2) for x in range(4) if (y, x) != (1, 3)] + [(1, y, x, None) for y in range(2) for x in range(2)]
    got = L.merged_leaves(spark.createDataFrame(modes, "frame long, row long, col long, mode string"), 2).collect()
    assert {(r.frame, r.leaf_row, r.leaf_col): r["mode"] for r in got} == {(0, 0, 0): "skip", (0, 0, 1): None, (1, 0, 0): None}


def test_a_candidate_must_dominate(spark):
    one = "array<struct<at long, rate long, distortion long>>"
    rows = [([(0, 9, 9), (1, 8, 10), (2, 9, 8), (3, 9, 8), (4, 1, 8)],), ([(0, 1, 1)],)]
    got = spark.createDataFrame(rows, f"c {one}").select(L.dominating(F.col("c"))["at"].alias("at")).collect()
    assert [r.at for r in got] == [4, 0]


def test_smooth_predictors_of_flat_and_ramp(spark):
    ramp = [8 * (i // 8) for i in range(64)]
    got = L.smooth_errors(spark.createDataFrame([(0, [7] * 64), (1, ramp)], "block_id long, px array<int>")).orderBy("block_id").collect()
    assert tuple(got[0])[1:] == (0, 0, 0, "smooth")
    # rows that rise evenly: across a row the left sample is pulled to the far corner, down a column a line is drawn
    assert got[1]["smooth"] < got[1]["horizontal"]


def test_leaf_order_and_hashes(spark):
    blocks = spark.createDataFrame([(i, [i % 256] * 64) for i in range(128)], "block_id long, px array<int>")
    order = {r.block_id: r.z for r in L.leaf_order(blocks).collect()}
    assert [order[i] for i in (0, 1, 8, 9, 2, 63, 64)] == [0, 1, 2, 3, 4, 63, 0]
    hashes = {r[0] for r in blocks.select(L.shift_hash(F.col("px"))).collect()}
    assert len(hashes) == 128 and all(0 <= h < 2**32 for h in hashes)
