"""How work is dealt: what would send samples more often than needed, meet them pair by pair, or leave all to one task."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinoframe.operators import copies as M
from kinoframe.operators import kernels as A
from kinoframe.operators import palettes as L
from kinoframe.plans import pictures as P
from kinoframe.plans.pictures import pictures
from kinoframe.sources import frames as V

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_are_dealt_by_frame(spark):
    d = pictures(spark, DATA).select("frame", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["frame"] for r in d}) == len(d) and len({r["task"] for r in d}) > 1


def test_cascade_is_the_first_equal_block(spark):
    rnd = random.Random(5)
    grid = lambda n: {(r, c): rnd.choice([0, 0, 0, *range(1, n)]) for r in range(9) for c in range(14) if rnd.random() < 0.95}
    films = [grid(4), grid(40), grid(90), {p: 0 for p in grid(2)}, {p: 0 for p in grid(2)}]
    rows = [(f, r, c, [v] * 3) for f, g in enumerate(films) for (r, c), v in g.items()]
    steps, want = [(0, 0), *((s * r, s * c) for s in M.NEAR for r, c in M.DIRECTIONS)], {}
    for f in range(1, len(films)):
        for (r, c), v in films[f].items():
            equal = [p for p, w in films[f - 1].items() if w == v]
            near = [k for k, (dr, dc) in enumerate(steps) if (r + dr, c + dc) in equal]
            if near:
                want[f, r, c] = ("near" if near[0] else "in place", *steps[near[0]])
            elif equal:
                want[f, r, c] = ("anywhere", *min(((p[0] - r, p[1] - c) for p in equal), key=lambda t: (abs(t[0]) + abs(t[1]), t)))
    d = M.motion_cascade(spark.createDataFrame([*rows, (1, 99, 99, None), (0, 99, 99, None)], "frame long, row long, col long, px array<int>"))
    got = {(r["frame"], r["row"], r["col"]): (r["source"], r["mv_row"], r["mv_col"]) for r in d.collect()}
    assert got == want and {w[0] for w in want.values()} == {"in place", "near", "anywhere"}
    assert "Generate" not in plan(d)  # samples are not sent once a step


def test_vectors_of_many_pictures(spark):
    """Runs of pictures, some missing, cut by batches anywhere: each is decided as if alone with the one before it."""
    rng, films, rows = np.random.default_rng(4), {}, []
    for f in range(-20, 180):
        last = films.get(f - 1, rng.integers(0, 30, (5, 7)))
        films[f] = np.where(rng.random((5, 7)) < 0.2, rng.integers(-1, 40, (5, 7)), np.roll(last, int(rng.integers(-2, 3)), 1))
    for f in (3, 16, 47, 64, 65, 66):
        del films[f]
    for f, g in films.items():
        rows += [(f, r, c, [int(g[r, c])] * (1 + int(g[r, c]) % 3)) for r, c in np.ndindex(5, 7) if g[r, c] >= 0]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 50)
    try:
        d = M.frame_vectors(spark.createDataFrame(rows, "frame long, row long, col long, px array<int>"))
        got = {(r["frame"], r["row"], r["col"]): (r["source"], r["mv_row"], r["mv_col"]) for r in d.collect()}
    finally:
        spark.conf.unset(key)
    want = {}
    for f, g in films.items():
        source, mv = M.vectors(g, films.get(f - 1, np.full((5, 7), -1)))
        want |= {(f, r, c): (M.SOURCES[source[r, c]], *mv[r, c].tolist()) if source[r, c] >= 0 else (None,) * 3 for r, c in np.ndindex(5, 7) if g[r, c] >= 0}
    assert got == want and {w[0] for w in want.values()} == {*M.SOURCES, None}
    assert "Union" not in plan(d) and "Join" not in plan(d)  # samples are sent once, not as both pictures
    stack = np.stack([films[0], films[1]]), np.stack([np.full((5, 7), -1), films[0]])
    for whole, alone in zip(M.vectors(*stack), zip(*map(M.vectors, *stack), strict=True), strict=True):
        assert (whole == np.stack(alone)).all()


def test_frequencies_of_many_colours(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(m) for _ in range(n)]) for i, (n, m) in enumerate([(0, 1), (1, 5), (300, 7), (300, 200), (9000, 5000)])] + [(9, None)]
    d = L.frequency_order(spark.createDataFrame(rows, "block_id long, px array<int>"))
    want = {i: px and sorted(set(px), key=lambda v, px=px: (-px.count(v), px.index(v))) for i, px in rows}
    assert {r["block_id"]: r["colours"] for r in d.collect()} == want
    assert "lambda" not in plan(d)


def test_metrics_send_no_samples(spark):
    for name in ("picture_metrics", "log_frame_metrics"):
        assert plan(entry.queries()[name](spark, DATA)).count("Join ") == 1  # the broadcast one of pictures


def test_kinds_are_dealt_by_number(spark):
    d = spark.createDataFrame([(0, 0, 0, [1]), (1, 0, 0, [1]), (2, 0, 0, [2])], "frame long, row long, col long, px array<int>")
    k = M.picture_kinds(d)
    assert plan(k).count("RepartitionByExpression") >= 2
    assert {r["frame"]: (r["kind"], r["shown"]) for r in k.collect()} == {0: ("key", 0), 1: ("existing", 0), 2: ("inter", 2)}


def test_a_file_is_many_tasks_work(spark, tmp_path):
    rows = [(f"{tmp_path}/a", i, bytes([i % 256]) * (4 + i % 3)) for i in range(500)]
    d = spark.createDataFrame(rows, V.FRAME).repartition(3)
    done = V.write_frames(d, b"head", b"M", part=32).collect()
    assert [(r["path"], r["frames"]) for r in done] == [(f"{tmp_path}/a", 500)] and (tmp_path / "a").read_bytes() == b"head" + b"".join(b"M" + x for _, _, x in rows)
    assert not list((tmp_path / "_parts").iterdir())
    (tmp_path / "b").write_bytes(bytes(800))
    places = V.raw_places(V.files(spark, str(tmp_path / "b")), F.lit(1).cast("long"))
    got = V.read_frames(places).select("frame", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 800 and len({r["task"] for r in got}) > 1


def test_equal_frames_are_sorted_by_many_tasks(spark, tmp_path):
    """Frames that are sent as few bytes: an adaptive plan must not join their parts into one task."""
    d = spark.range(64).selectExpr(f"concat('{tmp_path}/', id % 2) AS path", "id div 2 AS frame", "cast(repeat('x', 1000) AS binary) AS data")
    done = V.write_frames(d, part=4)
    assert done._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert sorted(r["frames"] for r in done.collect()) == [32, 32] and (tmp_path / "1").read_bytes() == b"x" * 32000


def test_more_pictures_are_more_tasks(spark, tmp_path, monkeypatch):
    """However few partitions the session has: a task must not sort more samples and frames as tables grow."""
    few = entry.queries()["file_y4m_digests"](spark, DATA).collect()
    monkeypatch.setattr(P, "PLACES_A_TASK", 100)
    assert pictures(spark, DATA).rdd.getNumPartitions() == 15
    many = entry.queries()["file_y4m_digests"](spark, DATA).collect()
    assert sorted(many) == sorted(few) and len(many) == 2
    d = spark.createDataFrame([(f"{tmp_path}/a", i, bytes([i])) for i in range(40)], V.FRAME)
    done = V.write_y4m(d, 1, 1, "1:1", "mono", tasks=40)
    assert "40), REPARTITION_BY_NUM" in done._jdf.queryExecution().executedPlan().toString()
    assert [r["frames"] for r in done.collect()] == [40] and (tmp_path / "a").read_bytes().endswith(b"".join(b"FRAME\n" + bytes([i]) for i in range(40)))


def test_totals_of_planes(spark):
    d = spark.createDataFrame([("a", 0, 0, [5, 0, 7]), ("a", 0, 1, [])], "path string, frame long, plane int, px array<int>")
    assert sorted(tuple(r) for r in V.plane_totals(d).collect()) == [("a", 0, 0, 3, 12, 26), ("a", 0, 1, 0, 0, 0)]


def test_areas_are_grouped_by_block(spark):
    rows = [(0, r, c, [(r * 31 + c * 17 + i * 7) % 256 for i in range(64)]) for r in range(2) for c in range(3)]
    d = A.areas(spark.createDataFrame(rows, "frame long, row long, col long, px array<int>"))
    px = {(r * 2 + y // 4, c * 2 + x // 4): [v[8 * (y + i // 4) + x + i % 4] for i in range(16)] for _, r, c, v in rows for y in (0, 4) for x in (0, 4)}
    for a in d.collect():
        at = lambda dy, dx, a=a: px.get((a.y + dy, a.x + dx))
        up, left = at(-1, 0), at(0, -1)
        assert a.px == at(0, 0) and (a.has_above, a.has_left) == (up is not None, left is not None)
        assert a.above == (up[12:] + (at(-1, 1)[12:] if at(-1, 1) else [up[15]] * 4) if up else [127] * 8)
        assert a.left == (left[3::4] + (at(1, -1)[3::4] if at(1, -1) else [left[15]] * 4) if left else [129] * 8)
        assert a.corner == ((left[3] if left else 128) if not up else up[12] if not left else at(-1, -1)[15])
    assert "Aggregate [frame#" in plan(d) and plan(d).count("Generate") == 2 and plan(d).index("Generate") < plan(d).index("Aggregate")  # areas come after the grouping


def test_regions_of_a_frame_stay_in_its_task(spark):
    d = entry.queries()["picture_region_palettes"](spark, DATA)
    assert d._jdf.queryExecution().sparkPlan().toString().count("mapInArrow") <= 1 and d.columns == ["region", "palette", "cost"]
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = d.collect()
    blocks = pictures(spark, DATA).select((F.col("frame") * 1000 + F.floor(F.col("row") / 2) * 50 + F.floor(F.col("col") / 2)).alias("region")).distinct().count()
    assert len(rows) == blocks == len({r["region"] for r in rows})
