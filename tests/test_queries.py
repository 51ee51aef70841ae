import pytest
from compare import DATA, duck_rows, spark_rows

from kinoframe import coding_queries, file_queries, kernel_queries, layout_queries, media_queries, metadata_queries, picture_queries, queries, run_queries, screen_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def blocks_of(spark, px):
    return spark.createDataFrame([(i, 1, p) for i, p in enumerate(px)], "block_id long, label int, px array<int>")


def test_blocks_match_on_all_samples(spark):
    from kinoframe.operators import blocks as B
    from kinoframe.operators import coding as C

    px = [[5] * 64, [5] * 63 + [6], [5] * 64, [5] * 63 + [6], [5] * 63 + [6]]
    df = blocks_of(spark, px)
    assert sorted(map(tuple, B.block_matches(df).collect())) == [(2, 0, 2), (3, 1, 2), (4, 1, 3)]
    assert [r["kind"] for r in C.frame_kinds(df, None).orderBy("block_id").collect()] == ["key", "inter", "inter", "inter", "existing"]
    # two frames of blocks that differ in the last sample only: block i moves one column on
    frames = [[5] * 63 + [i] for i in range(64)] + [[5] * 63 + [(i - 1) % 64 if i % 8 else 200] for i in range(64)]
    got = C.motion_matches(blocks_of(spark, frames), None).collect()
    assert len(got) == 56 and {(r["candidates"], r["mv_row"], r["mv_col"]) for r in got} == {(1, 0, -1)}
    assert [r["mode"] for r in C.frame_modes(blocks_of(spark, frames), None).orderBy("frame").collect()] == ["intra", "partial"]


def test_flat_frames_match_in_place(spark):
    from kinoframe.operators import coding as C

    flat, other = [[5] * 64] * 64, [[5] * 64 if i % 8 < 4 else [9] * 64 for i in range(64)]
    moved = [[9] * 64 if i % 8 < 4 else [5] * 64 for i in range(64)]
    df = blocks_of(spark, flat + flat + other + moved)
    assert [r["mode"] for r in C.frame_modes(df, None).orderBy("frame").collect()] == ["intra", "unchanged", "partial", "mixed"]
    px, got = [r["px"] for r in df.orderBy("block_id").collect()], {}
    for b in range(64, 256):
        f, y, x = b // 64, b % 64 // 8, b % 8
        refs = [(abs(j // 8 - y) + abs(j % 8 - x), j // 8, j % 8) for j in range(64) if px[64 * (f - 1) + j] == px[b]]
        if refs:
            got[b] = (f, len(refs), min(refs)[1] - y, min(refs)[2] - x)
    assert {r[0]: tuple(r[1:]) for r in C.motion_matches(df, None).collect()} == got


def test_palettes_count_samples_as_they_are(spark, tmp_path):
    px = [[7] * 64, [10, 11] * 32, [5] * 63 + [6], [0, 1, 2, 3] * 16, [0, 64, 128, 192] * 16, [0, 1, 2, 3, 4] * 12 + [0] * 4, list(range(64))]
    rows = [(i, 1, [(v + 0.5) / 200 - 0.6 for v in p]) for i, p in enumerate(px)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["block_palettes"](spark, str(tmp_path)).orderBy("block_id").collect()
    assert [tuple(r)[1:] for r in got] == [(len(set(p)), max(p) - min(p), 2 <= len(set(p)) <= 4) for p in px]
    assert [r["palette_worthy"] for r in got] == [False, True, True, True, True, False, False]


def test_walsh_hadamard_of_every_quarter(spark):
    from kinoframe.operators import blocks as B

    px = [[0] * 4 + [1] * 4] * 4 + [[2, 3] * 2 + [7] * 4] * 4
    got = B.walsh_hadamard_quarters(blocks_of(spark, [sum(px, [])])).orderBy("quarter").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (0, 1, 16, 0), (0, 2, 40, 8), (0, 3, 112, 0)]


def test_errors_of_equal_blocks_have_no_psnr(spark):
    from kinoframe.operators import blocks as B

    df = spark.createDataFrame([(0, 1, [7] * 64), (64, 1, [7] * 64), (128, 1, [8] * 64)], "block_id long, label int, px array<int>")
    got = {r["block_id"]: (r["sad"], r["sse"], r["psnr"]) for r in B.errors(B.previous(df)).collect()}
    assert got[64] == (0, 0, None) and got[128][:2] == (64, 64)


def test_strict_mean_and_reasons(spark):
    from kinoframe.operators import reports as R

    inf = float("inf")
    rows = [(1, 2.0), (1, 4.0), (2, inf), (2, inf), (3, 1.0), (3, inf)]
    got = {r["k"]: r["mean"] for r in R.psnr_mean(spark.createDataFrame(rows, "k int, x double"), "k", "x").collect()}
    assert got == {1: 3.0, 2: inf, 3: None}
    logs = [(0, "ok\n x error: bad \nFAIL: late"), (1, "a\n b \n\n"), (2, None), (3, " \n")]
    got = {r["k"]: r["reason"] for r in R.failure_reasons(spark.createDataFrame(logs, "k int, t string"), "k", "t").collect()}
    assert got == {0: "x error: bad", 1: "b", 2: R.NO_REASON, 3: R.NO_REASON}


def test_key_value_lines_and_manifests(spark, tmp_path):
    from pyspark.sql import functions as F

    from kinoframe.sources import text as X

    df = spark.createDataFrame([("a=1 b=x=y noise a=2 =z c=",)], "value string")
    assert df.select(X.key_values(F.col("value"))).first()[0] == {"a": "2", "b": "x=y", "c": ""}
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n long, s string")
    assert sorted(r["line"] for r in X.markdown_rows(rows, ["n", "s"]).collect()) == ["| 1 | a\\|b |", "| 2 | n/a |"]
    X.write_jsonl(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, X.read_jsonl(spark, str(tmp_path / "j"), "n long, s string, t int", {"t": 7}).collect())) == [(1, "a|b", 7), (2, None, 7)]
    X.write_manifest(rows, str(tmp_path / "m"))
    with pytest.raises(Exception, match="n|s"):
        X.read_manifest(spark, str(tmp_path / "m"), "other long, s string").collect()


def test_transform_pair_on_extremes(spark):
    from kinoframe.operators import samples as S

    px = [[255 * ((i * k) % 2) for i in range(64)] for k in (0, 1, 3)] + [[(i * 37 + 11) % 256 for i in range(64)]]
    got = S.wht(blocks_of(spark, px)).collect()
    assert len(got) == 16 and all(list(r["samples"]) == list(r["restored"]) and all(c % 8 == 0 for c in r["coefficients"]) for r in got)


def test_block_before_across_ranges(spark):
    from kinoframe.operators import blocks as B

    ids = [0, 1, 4095, 4096, 4097, 20000, 20001, 50000]
    rows = [(i, label, i) for label in (1, None) for i in ids if label or i != 4097]
    df = spark.createDataFrame(rows, "block_id long, label int, v long")
    want = {(label, i): max((j for j, other, _ in rows if other == label and j < i), default=None) for i, label, _ in rows}
    assert {(r["label"], r["block_id"]): r["b"] for r in B.before_in_label(df, "v", "b").collect()} == want
