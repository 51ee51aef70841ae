"""Rates, names, precedence, formats, tile limits, hashes, plain predictions and picture kinds by hand."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinoframe.operators import copies as M
from kinoframe.operators import formats, reports
from kinoframe.operators import kernels as A
from kinoframe.operators import layout as L
from kinoframe.operators import metadata as D
from kinoframe.sources import text as X


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_rates_are_exact(spark):
    texts = ["30", " 29.97 ", "30000/1001", "60000/2002", ".5", "24.", "0", "0/5", "5/0", "1/2/3", "fast", "-3", "4294967296/1", "1.2.3", ".", "", None, "000025", "999999999.999999999"]
    want = []
    for t in texts:
        try:
            r = Fraction(t.strip() if not t.strip().endswith(".") or t.strip() == "." else t.strip() + "0")
            r = r if r > 0 and not (t.count("/") and r.numerator > 2**32 - 1) else None
        except (ValueError, ZeroDivisionError, AttributeError):
            r = None
        want.append(r and (r.numerator, r.denominator))
    got = [r["r"] and tuple(r["r"]) for r in column(spark, texts).select("i", D.rate(F.col("v")).alias("r")).orderBy("i").collect()]
    assert got == want


def test_declared_rates(spark):
    film = F.struct(F.lit(30000).cast("long").alias("num"), F.lit(1001).cast("long").alias("den"))
    texts = {"30": True, "29": False, "30000/1001": True, "60000/2002": True, "30/1": False, "29.97": True, "29.98": True, "29.95": False, "x": None}
    got = {r["v"]: r["m"] for r in column(spark, texts).select("v", D.rates_match(F.col("v"), film).alias("m")).collect()}
    assert got == texts


def test_format_names(spark):
    names = {
        "yuv420p": ("420", 8, "yuv420p8"), " YUV444P10LE": ("444", 10, "yuv444p10le"), "yuv422p16": ("422", 16, "yuv422p16le"), "gray": ("400", 8, "gray8"), "y12le": ("400", 12, "gray12le"), "gbrp": ("gbr", 8, "gbrp8"),
        "rgb24": ("rgb", 8, "rgb24"), "i420": ("420", 8, "yuv420p8"), "i444": ("444", 8, "yuv444p8"), "i212": ("422", 12, "yuv422p12le"), "i010": ("420", 10, "yuv420p10le"), "yuv420p8le": ("420", 8, "yuv420p8"),
        "yuv420p17": None, "yuv420p7": None, "yuv410p": None, "yuv420p10be": None, "i310": None, "i0100": None, "gbrp10": None, "": None,
    }
    got = {r["v"]: r["f"] and tuple(r["f"]) for r in column(spark, names).select("v", D.parse_pixel_format(F.col("v")).alias("f")).collect()}
    assert got == names


def test_names_of_files(spark):
    rows = {
        "/films/Clip_1920x1080_5994_120f_yuv420p10le.yuv": (1920, 1080, "yuv420p10le", 120, "5994"),
        "a_640x480p2997_10frames.y4m": (640, 480, None, 10, "29.97"),
        "b-352X288.yuv": (352, 288, "yuv420p8", None, None),
        "c_12_16x8-25-i210.bin": (16, 8, "yuv422p10le", None, "25"),
        "d_0x8_3f.yuv": (None, 8, None, 3, None),
        "noise.yuv": (None, None, None, None, None),
        "e_8x8_gbrp_gray10.raw": (8, 8, "gray10le", None, None),
    }
    got = {r["file"]: (r["width"], r["height"], r["format"], r["frames"], r["fps"]) for r in D.infer_metadata(spark.createDataFrame([(f,) for f in rows], "file string")).collect()}
    assert got == rows


def test_options_come_before_headers_before_names(spark):
    kind = "struct<width: long, height: long, format: string, fps: string>"
    rows = [((8, 4, None, None), (16, 16, "gray8", "25/1"), (2, 2, "yuv420p8", "30")), (None, (16, 16, "gray8", None), (2, 2, "yuv420p8", "30")), (None, None, (2, 2, "yuv420p8", "30")), ((None, None, None, "50"), None, None)]
    d = spark.createDataFrame(rows, f"o {kind}, h {kind}, n {kind}")
    got = [tuple(r[0]) for r in d.select(D.resolved(F.col("o"), F.col("h"), F.col("n"))).collect()]
    assert got == [(8, 4, "gray8", "25/1"), (16, 16, "gray8", "30"), (2, 2, "yuv420p8", "30"), (None, None, None, "50")]


def test_settings_and_endpoints(spark):
    d = column(spark, ["av2:/a:b", ":x", "av2:", "av2", "lossless", "lossless=off", "qp=3=4"])
    got = d.select("v", D.endpoint(F.col("v")).alias("e"), D.setting(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r["e"] and tuple(r["e"]) for r in got][:4] == [("av2", "/a:b"), None, None, None]
    assert [tuple(r["s"]) for r in got][4:] == [("lossless", "true"), ("lossless", "off"), ("qp", "3=4")]
    assert [r[0] for r in column(spark, ["true", "1", "yes", "on", "false", "0", "no", "off"]).select(D.switch(F.col("v"))).collect()] == [True] * 4 + [False] * 4
    with pytest.raises(Exception, match="true or false"):
        column(spark, ["maybe"]).select(D.switch(F.col("v"))).collect()


def test_geometry_of_odd_and_missing_sides(spark):
    rows = [(0, "yuv420p", 5, 3), (1, "gbrp", 4, 4), (2, "gray16", 0, 8), (3, "yuv444p10", 2**32, 2**33), (4, "what", 8, 8), (5, "yuv422p9", 6, 3)]
    got = {r["id"]: (r["frame_bytes"], r["luma_bytes"], r["chroma_bytes"], r["valid"]) for r in formats.geometry(spark.createDataFrame(rows, "id int, name string, width long, height long")).collect()}
    assert got == {0: (27, 15, 6, False), 1: (48, 16, 16, True), 2: (0, 0, 0, False), 3: (None, None, None, True), 4: (None, None, None, False), 5: (72, 36, 18, True)}


def test_tiles_within_limits(spark):
    sizes = [(0, 1920, 1080), (1, 640, 480), (2, 8192, 64), (3, 64, 64), (4, 1024, 1080)]
    got = {r["id"]: (r["log2_cols"], r["log2_rows"]) for r in L.fast_tiles(spark.createDataFrame(sizes, "id int, width long, height long")).collect()}
    assert got == {0: (2, 1), 1: (0, 0), 2: (2, 0), 3: (0, 0), 4: (1, 1)}
    tiles = lambda cols, rows: spark.createDataFrame([(0, 640, 128, cols, rows)], "id long, width long, height long, log2_cols long, log2_rows long")
    assert L.tile_layout(L.checked_tiles(tiles(2, 1))).count() == 8
    for bad in ((5, 0), (0, 2)):
        with pytest.raises(Exception, match="beyond the limits"):
            L.checked_tiles(tiles(*bad)).collect()


def packets(planes, size):
    h, mask = 0x811C9DC5, 0xFFFFFFFF
    turned = lambda v, k: (v << k | v >> 32 - k) & mask
    for plane, px in enumerate(planes):
        for y in range(8):
            row = b"".join(v.to_bytes(size, "little") for v in px[8 * y : 8 * y + 8])
            for k in range(0, len(row), 8):
                low, high = (int.from_bytes(row[k + 4 * j : k + 4 * j + 4], "little") for j in (0, 1))
                r = h ^ low ^ turned(high, 5) ^ (plane << 10 | (y * len(row) + k) << 4 | 8)
                h = r ^ turned(r, 13) ^ (r << 7 & mask) ^ r >> 11
    return h


def test_packet_hashes(spark):
    rng = np.random.default_rng(3)
    for size, top in ((1, 256), (2, 1024)):
        rows = [[rng.integers(0, top, 64).tolist() for _ in range(3)] for _ in range(4)] + [[[7] * 64] * 3]
        d = spark.createDataFrame(rows, "y array<int>, u array<int>, v array<int>")
        got = [r[0] for r in d.select(L.packet_hash([F.col("y"), F.col("u"), F.col("v")], size)).collect()]
        assert got == [packets(r, size) for r in rows] and len(set(got)) == len(rows)


def test_plain_predictions_at_edges_and_depths():
    above, left, corner = np.array([[10, 20, 30, 40, 50, 0, 0, 0]]), np.array([[11, 21, 31, 41, 51, 0, 0, 0]]), np.array([9])
    yes, no = np.array([True]), np.array([False])
    p = A.plain_predictions(above, left, corner, yes, yes)
    assert p["dc"][0, 0] == (100 + 104 + 4) // 8 and p["v"].reshape(4, 4).tolist() == [[10, 20, 30, 40]] * 4 and p["h"].reshape(4, 4)[:, 0].tolist() == [11, 21, 31, 41]
    assert A.plain_predictions(above, left, corner, yes, no)["dc"][0, 0] == 25 and A.plain_predictions(above, left, corner, no, yes)["dc"][0, 0] == 26 and A.plain_predictions(above, left, corner, no, no, 10)["dc"][0, 0] == 512
    assert p["paeth"].reshape(4, 4)[0, 0] in (10, 11)
    for depth in (8, 10, 12):
        flat = np.full((1, 8), (1 << depth) - 1)
        for q in A.plain_predictions(flat, flat, flat[:, 0], yes, yes, depth).values():
            assert (q == (1 << depth) - 1).all()
    # the first row leans on the edge above by half, the last not at all
    smooth = A.plain_predictions(above * 0 + 100, left * 0, corner, yes, yes)["smooth_v"].reshape(4, 4)
    assert smooth[0, 0] > smooth[1, 0] > smooth[2, 0] > smooth[3, 0] == 0


def test_kinds_of_pictures_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 3)
    seen = {0: 5, 1: 5, 2: 5, 3: 5, 4: 6, 5: 5, 7: 5, 8: 5, 9: 5, 10: 5, 11: 5, 12: 7}
    rows = [(f, 0, c, [v + c] * 64) for f, v in seen.items() for c in range(2)] + [(13, 0, 0, [7] * 64)]
    got = {r["frame"]: (r["kind"], r["shown"]) for r in M.picture_kinds(spark.createDataFrame(rows, "frame long, row long, col long, px array<int>")).collect()}
    e = "existing"
    assert got == {0: ("key", 0), 1: (e, 0), 2: (e, 0), 3: (e, 0), 4: ("inter", 4), 5: ("inter", 5), 7: ("key", 7), 8: (e, 7), 9: (e, 7), 10: (e, 7), 11: (e, 7), 12: ("inter", 12), 13: ("inter", 13)}


def test_modes_of_tiles(spark):
    place = [(f, 0, c) for f in range(5) for c in range(2)]
    blocks = spark.createDataFrame([(*p, [0] * 64) for p in place], "frame long, row long, col long, px array<int>")
    found = [(0, 0, 0, 0, 0), (0, 0, 1, 0, 0), (1, 0, 0, 0, 1), (1, 0, 1, 0, 1), (2, 0, 0, 0, 0), (2, 0, 1, 0, 1), (3, 0, 0, 0, 0)]
    got = {r["frame"]: (r["n_copied"], r["n_motions"], r["mode"], r["lossy"]) for r in M.tile_modes(blocks, spark.createDataFrame(found, "frame long, row long, col long, mv_row long, mv_col long")).collect()}
    assert got == {0: (2, 1, "unchanged", "unchanged"), 1: (2, 1, "motion", "moved"), 2: (2, 2, "mixed", "moved"), 3: (1, 1, "partial", "residual"), 4: (0, 0, "intra", "residual")}


def test_reports(spark):
    d = spark.createDataFrame([("a|b", 3), (None, 9)], "name string, bits long")
    got = [tuple(r) for r in X.markdown_table(d, ["name", "bits"], {"bits": False}).collect()]
    assert got == [(0, "| name | bits |"), (1, "| --- | --- |"), (2, "| n/a | 9 |"), (2, "| a\\|b | 3 |")]
    sb = spark.createDataFrame([("a", f, f * 10) for f in range(1, 6)], "case string, frame long, bits long")
    assert reports.first_frames(sb, 2).count() == 2 and reports.first_frames(sb, 0).count() == 5
