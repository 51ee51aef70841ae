import hashlib

import pytest
from pyspark.sql import functions as F

from kinoframe.operators import screens
from kinoframe.sources import frames as V


def made(spark, path, n, size):
    rows = [(f"{path}/{s}", i, bytes((s * 50 + i * 7 + k) % 256 for k in range(size))) for s in (1, 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "path string, frame long, data binary").repartition(5)


def as_rows(df):
    return sorted((r["path"].removeprefix("file:"), r["frame"], bytes(r["data"])) for r in df.collect())


def test_raw_files_come_back(spark, tmp_path):
    rows, df = made(spark, tmp_path, 70, 24)
    done = {r["path"]: (r["frames"], r["sha256"]) for r in V.write_frames(df).collect()}
    for p in {r[0] for r in rows}:
        assert done[p] == (70, hashlib.sha256(b"".join(d for q, _, d in rows if q == p)).hexdigest())
    assert not list(tmp_path.glob("*.part"))
    listed, size = V.files(spark, str(tmp_path)), V.frame_bytes(F.lit("420"), F.lit(8), F.lit(4), F.lit(4))
    assert as_rows(V.read_frames(V.raw_places(listed, size))) == rows
    assert as_rows(V.read_frames(V.raw_places(listed, size, frames=3))) == [r for r in rows if r[1] < 3]
    with pytest.raises(Exception, match="ends within a frame"):
        V.raw_places(listed, F.lit(25).cast("long")).collect()
    assert V.raw_places(listed, F.lit(25).cast("long"), frames=1000).count() == 2 * (70 * 24 // 25)
    assert V.raw_places(listed.where("false"), size).count() == 0


def test_planes_of_frames(spark):
    px = list(range(300, 300 + 5 * 3 + 2 * 3 * 2))
    df = spark.createDataFrame([("a", 0, b"".join(x.to_bytes(2, "little") for x in px))], V.FRAME)
    got = {r["plane"]: (r["width"], r["height"], list(r["px"])) for r in V.planes(df, "420", 10, 5, 3).collect()}
    assert got == {0: (5, 3, px[:15]), 1: (3, 2, px[15:21]), 2: (3, 2, px[21:])}
    with pytest.raises(Exception, match="more than 9 bits"):
        V.planes(df.withColumn("data", F.unhex(F.lit("ff0f" * 27))), "420", 9, 5, 3).collect()


def test_y4m_files_come_back(spark, tmp_path):
    rows, df = made(spark, tmp_path, 5, 48)
    V.write_y4m(df, 4, 4, "30000:1001", "420p10").collect()
    odd = tmp_path / "3"
    odd.write_bytes(b"YUV4MPEG2 W2 H2 F25:1\nFRAME Ip\nabcdefFRAME\nghijkl")
    heads = V.y4m_headers(V.files(spark, str(tmp_path)))
    got = {r["path"][-1]: (r["width"], r["height"], r["fps"], r["sampling"], r["depth"], r["size"]) for r in heads.collect()}
    assert got["1"] == (4, 4, "30000:1001", "420", 10, 48) and got["3"] == (2, 2, "25:1", "420", 8, 6)
    assert as_rows(V.read_frames(V.y4m_places(heads))) == sorted([*rows, (str(odd), 0, b"abcdef"), (str(odd), 1, b"ghijkl")])
    planned = heads.select("path", "width", "height", "sampling", "depth")
    assert V.check_headers(heads, planned).count() == 3
    with pytest.raises(Exception, match="header differs"):
        V.check_headers(heads, planned.withColumn("depth", F.lit(8))).collect()
    for bad, why in ((b"YUV4MPEG W2 H2\n", "no Y4M header"), (b"YUV4MPEG2 W2 H2\nFRAMExx\nabcdef", "no frame marker"), (b"YUV4MPEG2 W2 H2\nFRAME\nabc", "ends within"), (b"YUV4MPEG2 W2 H2 C411\nFRAME\nabc", "unknown chroma tag")):
        (d := tmp_path / why.replace(" ", "")).mkdir()
        (d / "x").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            V.y4m_places(V.y4m_headers(V.files(spark, str(d)))).collect()


def test_tiles_of_frames(spark):
    a, b = "x" * 64, "é" * 70
    docs = [(1, a + b), (2, a + b), (3, None), (4, ""), (5, b), (6, "new")]
    got = {r["frame"]: (r["n_tiles"], r["seen"], r["still"], r["mode"]) for r in screens.tile_modes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (3, 0, 0, "new"), 2: (3, 3, 3, "unchanged"), 3: (0, 0, 0, "empty"), 4: (0, 0, 0, "empty"), 5: (2, 2, 0, "partial"), 6: (1, 0, 0, "new")}
