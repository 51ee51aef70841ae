"""Reports on recorded runs and drawn pictures by hand."""

import json

import pytest
from pyspark.sql import functions as F

from kinoframe.operators import runs as R
from kinoframe.sources import patterns as D
from kinoframe.sources import text as X

RUN = "vector string, returncode int, log string, output_bytes long, recon_bytes long, recon_sha string, source_bytes long, source_sha string, mode string, decode_code int, decode_log string, reference_bytes long, reference_sha string, packed boolean"
GOOD = ("v", 0, "", 10, 64, "a", 64, "a", "on", 0, "", 64, "a", False)


def verdict(spark, **changes):
    names = [c.split()[0] for c in RUN.split(", ")]
    row = dict(zip(names, GOOD, strict=True)) | changes
    r = R.validation(spark.createDataFrame([tuple(row[n] for n in names)], RUN)).collect()
    return r[0]["status"], r[0]["reason"]


def test_the_first_broken_rule_counts(spark):
    assert verdict(spark) == ("PASS", f"{R.SOURCE_MATCHES}; {R.REFERENCE_MATCHES}")
    assert verdict(spark, source_sha=None, packed=True) == ("PASS", R.REFERENCE_MATCHES + R.AFTER_PACKING)
    assert verdict(spark, mode="off", decode_code=1, reference_sha=None) == ("PASS", R.SOURCE_MATCHES)
    assert verdict(spark, mode="off", source_sha=None) == ("PASS", R.PRODUCED)
    assert verdict(spark, returncode=3, log="a\n  FAIL: x \nb", output_bytes=None) == ("FAIL", "FAIL: x")
    assert verdict(spark, returncode=3, log=None) == ("FAIL", "encoder command failed")
    assert verdict(spark, output_bytes=None, recon_sha=None) == ("FAIL", R.NO_OUTPUT)
    assert verdict(spark, output_bytes=0, recon_sha=None) == ("FAIL", R.EMPTY_OUTPUT)
    assert verdict(spark, recon_sha=None) == ("FAIL", R.NO_RECON)
    assert verdict(spark, source_bytes=65, source_sha="b") == ("FAIL", "lossless reconstruction length differs from source (64 != 65)")
    assert verdict(spark, source_sha="b") == ("FAIL", R.SOURCE_DIFFERS)
    assert verdict(spark, decode_code=1, decode_log="no decoder") == ("FAIL", "reference decode failed: no decoder")
    assert verdict(spark, decode_code=2, mode="auto", decode_log="no decoder", reference_sha=None) == ("PASS", f"{R.SOURCE_MATCHES}; reference decode skipped: no decoder")
    assert verdict(spark, decode_code=2)[0] == "FAIL"
    assert verdict(spark, reference_sha=None) == ("FAIL", R.NO_REFERENCE)
    assert verdict(spark, reference_bytes=0) == ("FAIL", R.EMPTY_REFERENCE)
    assert verdict(spark, reference_sha="c") == ("FAIL", R.REFERENCE_DIFFERS)


def test_means_of_logged_metrics(spark):
    lines = [("a", "frame: psnr_all=40.5 x"), ("a", "psnr_all=+1.5 psnr_all=.5"), ("b", "psnr_all=inf"), ("b", "psnr_all=inf"), ("c", "psnr_all=inf psnr_all=3"), ("d", "xpsnr_all=3 psnr=4"), ("e", None)]
    got = {r["log"]: (r["n"], r["mean"]) for r in R.logged_psnr(spark.createDataFrame(lines, "log string, line string"), "log", "line").collect()}
    assert got == {"a": (3, 42.5 / 3), "b": (2, float("inf")), "c": (2, None), "d": (0, None), "e": (0, None)}


def test_metrics_and_lines(spark):
    kind = "frame long, row long, col long, px array<int>, cb array<int>, cr array<int>"
    source = spark.createDataFrame([(0, 0, c, [10, 20], [5, 5], [1, 2]) for c in range(2)], kind)
    coded = spark.createDataFrame([(0, 0, c, [10, 21], [5, 5], [3, 2]) for c in range(2)], kind)
    m = R.frame_metrics(source, coded).collect()[0]
    assert (round(m["psnr_y"], 3), m["psnr_u"], round(m["psnr_v"], 3), round(m["psnr_all"], 3)) == (51.141, float("inf"), 45.121, 48.923)
    d = spark.createDataFrame([("x", "vvc", 2, 9, 51.1411, float("inf"), None, 3.0)], "log string, codec string, at int, bytes long, psnr_y double, psnr_u double, psnr_v double, psnr_all double")
    assert R.metric_lines(d, F.lit(3)).collect()[0]["line"] == "frame: codec=vvc index=2/3 bits=72 bytes=9 psnr_y=51.141 psnr_u=inf psnr_v=n/a psnr_all=3.000"


def test_changes_against_a_baseline(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"run": 1, "results": [{"f": "a", "bytes": 10, "fps": 2.0, "psnr_all_mean": 30.0}, {"f": "b", "bytes": 4, "fps": 1.0, "psnr_all_mean": None}]}, indent=1))
    old = X.read_report(spark, str(tmp_path / "old.json"), "f: string, bytes: bigint, fps: double, psnr_all_mean: double")
    now = spark.createDataFrame([("a", 7, 2.5, 31.0), ("b", 5, 1.0, 40.0), ("c", 1, 1.0, 1.0)], "f string, bytes long, fps double, psnr_all_mean double")
    got = {r["f"]: (r["delta_bytes"], r["delta_fps"], r["delta_psnr"], r["label"]) for r in R.with_deltas(now, old, ["f"]).withColumn("label", R.delta_label(F.col("delta_bytes"), F.col("delta_fps"))).collect()}
    assert got == {"a": (-3, 0.5, 1.0, " bytes_delta=-3 fps_delta=+0.50"), "b": (1, 0.0, None, " bytes_delta=+1 fps_delta=+0.00"), "c": (None, None, None, "")}
    (tmp_path / "none.json").write_text("{}")
    assert X.read_report(spark, str(tmp_path / "none.json"), "f: string").count() == 0


def test_ratios_of_sums(spark):
    d = spark.createDataFrame([("a", 10, 2.0, 30, 10), ("b", 5, 0.0, 10, 0)], "vector string, frames long, seconds double, bytes long, reference_bytes long")
    got = {r["vector"]: (r["fps"], r["ratio"]) for r in R.comparison(d).collect()}
    assert got == {"a": (5.0, 3.0), "b": (float("inf"), float("inf")), None: (7.5, 4.0)}


def test_trace_specs():
    assert [X.trace_spec(s) for s in ("case/src=/a/b.jsonl", "src=/a/b.jsonl", "/a/b.jsonl", "=/a/b.jsonl", "case/=x.y.z", " /src=b")] == [("case", "src", "/a/b.jsonl"), ("b", "src", "/a/b.jsonl"), ("b", None, "/a/b.jsonl"), ("b", None, "/a/b.jsonl"), ("case", None, "x.y.z"), ("b", "src", "b")]


def drawn(spark, *spec):
    rows = D.pattern_planes(spark.createDataFrame([(1, *spec)], "id int, kind string, width long, height long, frames long, sampling string, depth int")).collect()
    return {(r["frame"], r["plane"]): (r["width"], r["height"], r["px"]) for r in rows}


def test_patterns(spark):
    p = drawn(spark, "checker", 16, 8, 2, "420", 8)
    assert p[0, 0] == (16, 8, ([208] * 8 + [48] * 8) * 8) and p[1, 0][2][:16] == [48] * 8 + [208] * 8 and p[0, 1] == (8, 4, ([176] * 4 + [96] * 4) * 4)
    g = drawn(spark, "gradient", 8, 2, 1, "422", 10)
    assert g[0, 0][2] == [4 * ((7 * x + 5 * y) % 256) for y in range(2) for x in range(8)]
    assert g[0, 1] == (4, 2, [4 * ((64 + 6 * x + 64 + 6 * x + 3) // 2) for _ in range(2) for x in range(4)])
    c = drawn(spark, "bitdepth_canary", 16, 16, 2, "444", 10)
    assert len(c) == 6 and all(v & 3 for _, _, px in c.values() for v in px) and c[0, 0][2][0] == 32 * 4 + 3 and c[0, 0][2][1] == 32 * 4 + 1
    assert drawn(spark, "black", 8, 8, 0, "444", 8) == {}
    for bad in (("what", 8, 8, 1, "444", 8), ("black", 7, 8, 1, "420", 8), ("bitdepth_canary", 8, 8, 1, "444", 8), ("black", 8, 8, 1, "400", 8), ("black", 8, 8, 1, "444", 17)):
        with pytest.raises(Exception, match="cannot be drawn"):
            drawn(spark, *bad)


def test_patterns_are_drawn_by_many_tasks(spark):
    films = spark.createDataFrame([(i, "gradient", 8, 4, 3, "444", 8) for i in range(40)], "id int, kind string, width long, height long, frames long, sampling string, depth int").coalesce(1)
    d = D.pattern_planes(films)
    tasks = d.select("id", "frame", F.size("px").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 360 and {r["n"] for r in tasks} == {32} and len({r["task"] for r in tasks}) > 1
    assert len({(r["id"], r["frame"], r["task"]) for r in tasks}) == 120  # the planes of a frame stay together
    with pytest.raises(Exception, match="cannot be drawn"):
        drawn(spark, "black", None, 8, 1, "444", 8)
