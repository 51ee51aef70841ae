"""The registered queries on files that are written, read by ranges and checked, each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .picture_queries import on_pictures
from .plans.bridges import table
from .plans.pictures import COLS, PLANES_SQL, ROWS, planes, tasks
from .queries import register
from .sources import bytestream as Y
from .sources import frames as V
from .sources import text as X
from .streaming.replay import shared_folder

WIDTH, HEIGHT = 8 * COLS, 8 * ROWS


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the pictures that are whole, with all planes; even and odd ones are two films."""
    p = planes(spark, sf_dir)
    full = p.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") == ROWS * COLS).select("frame")
    return p.join(full, "frame")


def films(frames: DataFrame, root: str, suffix: str) -> DataFrame:
    """(path, frame, data): even and odd pictures as two files, numbered from 0."""
    path = F.concat(F.lit(f"{root}/film-"), (F.col("frame") % 2).cast("string"), F.lit(suffix))
    return frames.select(path.alias("path"), F.floor(F.col("frame") / 2).alias("frame"), "data")


_WHOLE = f"planes AS ({PLANES_SQL}), whole AS (SELECT * FROM planes WHERE frame IN (SELECT frame FROM planes GROUP BY 1 HAVING count(*) = {ROWS * COLS}))"
_SAMPLES = "s AS (SELECT frame % 2 AS film, frame // 2 AS frame, plane, row * 8 + i // 8 AS y, col * 8 + i % 8 AS x, v[i + 1]::BIGINT AS v FROM (SELECT *, unnest(range(64)) AS i FROM (SELECT frame, row, col, unnest([px, cb, cr]) AS v, unnest([0, 1, 2]) AS plane FROM whole)))"


def plane_sums(p: DataFrame) -> DataFrame:
    film = F.regexp_extract("path", "film-([01])", 1).cast("long")
    return V.plane_totals(p).select(film.alias("film"), "frame", "plane", "n", "total", "weighted")


@on_pictures(f", {_WHOLE}, {_SAMPLES} SELECT film, frame, plane, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (y * {WIDTH} + x + 1))::BIGINT AS weighted FROM s GROUP BY ALL")
def file_raw_planes(spark, sf_dir):
    """Pictures written as headerless 4:4:4 files, read back by ranges of frames and cut into planes."""
    root = folder(spark)
    V.write_frames(films(V.frames_of_blocks(whole(spark, sf_dir), ROWS, COLS), root, ".yuv"), tasks=tasks(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    size = V.frame_bytes(F.lit("444"), F.lit(8), F.lit(WIDTH), F.lit(HEIGHT))
    return plane_sums(V.planes(V.read_frames(V.raw_places(V.files(spark, root), size)), "444", 8, WIDTH, HEIGHT))


_DEEP = f"{_SAMPLES}, k AS (SELECT film, frame, plane, v * 4 + v % 4 AS v, CASE WHEN plane = 0 THEN y * {WIDTH} + x ELSE y // 2 * {WIDTH // 2} + x // 2 END AS spot FROM s WHERE plane = 0 OR (y % 2 = 0 AND x % 2 = 0))"


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pictures as 4:2:0 frames of 10 bits."""
    ten = lambda c: F.transform(c, lambda v: v * 4 + v % 4).alias(c)
    return V.frames_of_blocks(whole(spark, sf_dir).select("frame", "row", "col", ten("px"), ten("cb"), ten("cr")), ROWS, COLS, "420", 10)


@on_pictures(f", {_WHOLE}, {_DEEP} SELECT film, frame, plane, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (spot + 1))::BIGINT AS weighted FROM k GROUP BY ALL")
def file_y4m_planes(spark, sf_dir):
    """Pictures written as Y4M files of 10-bit 4:2:0, their headers held against the plan, read back and cut into planes."""
    root = folder(spark)
    V.write_y4m(films(deep(spark, sf_dir), root, ".y4m"), WIDTH, HEIGHT, "30000:1001", "420p10", tasks=tasks(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    heads = V.y4m_headers(V.files(spark, root))
    planned = heads.select("path", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit("420").alias("sampling"), F.lit(10).alias("depth"))
    return plane_sums(V.planes(V.read_frames(V.y4m_places(V.check_headers(heads, planned))), "420", 10, WIDTH, HEIGHT))


@on_pictures(
    f", {_WHOLE}, {_DEEP}, f AS (SELECT film, frame, string_agg(printf('%02x%02x', v & 255, v >> 8), '' ORDER BY plane, spot) AS x FROM k GROUP BY ALL)"
    f" SELECT film, {WIDTH}::BIGINT AS width, {HEIGHT}::BIGINT AS height, '30000:1001' AS fps, '420' AS sampling, 10::BIGINT AS depth, count(*) AS frames, sha256(unhex(string_agg(x, '' ORDER BY frame))) AS sha256 FROM f GROUP BY film"
)
def file_y4m_digests(spark, sf_dir):
    """Y4M files: what their headers say, and the digest of all frames' bytes as they were written."""
    root = folder(spark)
    sums = f"{root}-sums"
    V.write_y4m(films(deep(spark, sf_dir), root, ".y4m"), WIDTH, HEIGHT, "30000:1001", "420p10", tasks=tasks(spark, sf_dir)).write.parquet(sums)
    film = lambda: F.regexp_extract("path", "film-([01])", 1).cast("long").alias("film")
    heads = V.y4m_headers(V.files(spark, root)).select(film(), "width", "height", "fps", "sampling", F.col("depth").cast("long").alias("depth"))
    return heads.join(spark.read.parquet(sums).select(film(), "frames", "sha256"), "film")


@on_pictures(f", {_WHOLE}, {_SAMPLES} SELECT film, frame, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY plane, y, x))) AS sha256 FROM s WHERE frame < 1 GROUP BY ALL")
def file_first_frames(spark, sf_dir):
    """The first frame of each headerless film, by its digest; a film without one would raise."""
    root = folder(spark)
    V.write_frames(films(V.frames_of_blocks(whole(spark, sf_dir), ROWS, COLS), root, ".yuv"), tasks=tasks(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    size = V.frame_bytes(F.lit("444"), F.lit(8), F.lit(WIDTH), F.lit(HEIGHT))
    d = V.read_frames(V.clip(V.raw_places(V.files(spark, root), size), 1))
    return d.select(F.regexp_extract("path", "film-([01])", 1).cast("long").alias("film"), "frame", F.sha2("data", 256).alias("sha256"))


@register(
    ", u AS (SELECT event_type AS stream, event_id, 2 + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 3 END AS head, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 3 END AS code, user_id % 32 AS unit_type, user_id % 56 AS layer_id, event_id % 7 AS temporal_id, strlen(props) AS payload_len FROM events)"
    " SELECT stream, (coalesce(sum(head + payload_len) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + code)::BIGINT AS unit_offset, unit_type, layer_id, temporal_id, payload_len FROM u"
)
def file_stream_units(spark, sf_dir):
    """Events written as units behind start codes, a file a type, and scanned in ranges of 999 bytes."""
    root = folder(spark)
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("00000001"))).otherwise(F.unhex(F.lit("000001")))
    byte = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0"))
    unit = F.concat(code, byte(F.col("user_id") % 56), byte(F.col("user_id") % 32 * 8 + F.col("event_id") % 7 + 1), F.encode("props", "utf-8"))
    d = e.select(F.concat(F.lit(f"{root}/"), F.col("event_type"), F.lit(".bin")).alias("path"), F.col("event_id").alias("frame"), unit.alias("data"))
    V.write_frames(d, part=1 << 16, tasks=e.count() >> 16).write.format("noop").mode("overwrite").save()
    u = Y.units(Y.byte_ranges(V.files(spark, root), 999))
    return u.select(F.regexp_extract("path", r"([^/]*)\.bin$", 1).alias("stream"), F.col("offset").alias("unit_offset"), "unit_type", "layer_id", "temporal_id", "payload_len")


@register(
    ", r AS (SELECT l_orderkey AS frame_index, 'run-' || (l_orderkey % 3) AS source, list({'name': l_returnflag || l_linestatus, 'ns': l_partkey * 7, 'n': l_linenumber}) AS l FROM lineitem WHERE l_orderkey % 7 <> 3 GROUP BY l_orderkey),"
    " o AS (SELECT DISTINCT l_orderkey AS frame_index, 'run-' || (l_orderkey % 3) AS source FROM lineitem), t AS (SELECT frame_index, source, t.name, t.ns, t.n FROM (SELECT *, unnest(l) AS t FROM r WHERE frame_index % 11 <> 5)),"
    " s AS (SELECT source, name AS stage, sum(ns)::BIGINT AS nanos, sum(n)::BIGINT AS count, count(DISTINCT frame_index) AS frames FROM t GROUP BY ALL UNION ALL SELECT source, '', 0, 0, count(*) FROM o ANTI JOIN t USING (frame_index) GROUP BY source)"
    " SELECT *, nanos / sum(nanos) OVER (PARTITION BY source) AS share FROM s"
)
def source_nested_stages(spark, sf_dir):
    """Statistics records with arrays of stages and counters, written as JSON lines: time by stage, records without stages kept."""
    return X.stage_totals(X.stats_rows(_records(spark, sf_dir)))


@register(
    ", r AS (SELECT l_orderkey AS frame_index, 'run-' || (l_orderkey % 3) AS source, l_linestatus AS name, l_suppkey AS value FROM lineitem), o AS (SELECT DISTINCT frame_index, source FROM r)"
    " SELECT source, name, count(*) AS n, sum(value)::BIGINT AS value, count(DISTINCT frame_index) AS frames FROM r WHERE frame_index % 7 <> 3 GROUP BY ALL UNION ALL SELECT source, NULL, count(*), 0, count(*) FROM o WHERE frame_index % 7 = 3 GROUP BY source"
)
def source_nested_counters(spark, sf_dir):
    """The counters of the same records; a record without counters has one row with a null name."""
    d = X.stats_rows(_records(spark, sf_dir)).where(F.col("table") == "counters")
    return d.groupBy("source", "name").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("value"), F.countDistinct("frame_index").alias("frames"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record an order: every seventh lacks both arrays, some have an empty array of stages."""
    path = folder(spark)
    key = F.col("l_orderkey")
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy(key.alias("frame_index")).agg(
        F.collect_list(F.struct(F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_partkey") * 7).alias("ns"), F.col("l_linenumber").alias("count"))).alias("stages"),
        F.collect_list(F.struct(F.col("l_linestatus").alias("name"), F.col("l_suppkey").alias("value"))).alias("counters"),
    )
    k = F.col("frame_index")
    stages = F.when(k % 7 == 3, None).when(k % 11 == 5, F.filter("stages", lambda _: F.lit(False))).otherwise(F.col("stages"))
    d = d.select(F.when(k >= 0, "stats.v1").alias("kind"), F.concat(F.lit("run-"), (k % 3).cast("string")).alias("source"), k, stages.alias("stages"), F.when(k % 7 != 3, F.col("counters")).alias("counters"), F.lit("ignored").alias("extra"))
    other = d.withColumn("kind", F.lit("stats.v0"))
    X.write_jsonl(d.union(other), path)
    return X.read_stats(spark, path, "stats.v1")
