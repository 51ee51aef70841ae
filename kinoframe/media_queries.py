"""More registered queries on samples, formats, logs and manifests, each with its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import formats as P
from .operators import reports as R
from .operators import samples as S
from .plans.bridges import blocks, superblocks, table
from .queries import register
from .sources import text as X
from .streaming.replay import shared_folder

_QUARTERS = ", q AS (SELECT block_id, q, x, px[8 * (4 * (q // 2)) + 4 * (q % 2) + x + 1]::BIGINT AS a, px[8 * (4 * (q // 2) + 1) + 4 * (q % 2) + x + 1]::BIGINT AS b, px[8 * (4 * (q // 2) + 2) + 4 * (q % 2) + x + 1]::BIGINT AS c, px[8 * (4 * (q // 2) + 3) + 4 * (q % 2) + x + 1]::BIGINT AS d FROM blocks, (SELECT unnest(range(4)) AS q), (SELECT unnest(range(4)) AS x))"
_LIFT = "SELECT *, s - (floor((s - t) / 2) - c)::BIGINT AS o0, (floor((s - t) / 2) - c)::BIGINT AS o1, t + (floor((s - t) / 2) - b)::BIGINT AS o2, (floor((s - t) / 2) - b)::BIGINT AS o3 FROM (SELECT *, a + b AS s, d - c AS t FROM {})"


@register(
    f"{_QUARTERS}, f AS ({_LIFT.format('q')}), r AS (SELECT block_id, q, y, max(v) FILTER (x = 0) AS a, max(v) FILTER (x = 1) AS b, max(v) FILTER (x = 2) AS c, max(v) FILTER (x = 3) AS d FROM (SELECT block_id, q, x, unnest([o0, o1, o2, o3]) AS v, unnest([0, 1, 2, 3]) AS y FROM f) GROUP BY ALL), g AS ({_LIFT.format('r')}), k AS (SELECT block_id, q, 4 * y + unnest([0, 1, 2, 3]) AS i, 8 * unnest([o0, o1, o2, o3]) AS v FROM g) "
    "SELECT block_id, q AS quarter, (sum(v) FILTER (i = 0))::BIGINT AS dc, (sum(abs(v)) FILTER (i > 0))::BIGINT AS ac, sum(v * (i + 1))::BIGINT AS weighted, true AS lossless FROM k GROUP BY block_id, q"
)
def block_lifted_transform(spark, sf_dir):
    return S.wht_summary(blocks(spark, sf_dir))


@register(
    ", s AS (SELECT block_id, i, px[i + 1]::BIGINT AS v, CASE WHEN i % 8 = 0 THEN 0 ELSE px[i] END::BIGINT AS l, CASE WHEN i < 8 THEN 0 ELSE px[i - 7] END::BIGINT AS a FROM (SELECT block_id, px, unnest(range(64)) AS i FROM blocks)) SELECT block_id, sum(abs(v - l))::BIGINT AS h_residual, sum(abs(v - a))::BIGINT AS v_residual, true AS lossless FROM s GROUP BY block_id"
)
def block_dpcm_round_trip(spark, sf_dir):
    return S.dpcm_pair(blocks(spark, sf_dir))


@register(
    ", s AS (SELECT block_id, v::BIGINT AS v, row_number() OVER (PARTITION BY block_id ORDER BY v) AS k FROM (SELECT block_id, unnest(px) AS v FROM blocks)), m AS (SELECT block_id, v AS median FROM s WHERE k = 32) SELECT block_id, sum(v * (65 - k))::BIGINT AS prefix_total, any_value(median) AS median, sum(abs(v - median))::BIGINT AS median_cost FROM s JOIN m USING (block_id) GROUP BY block_id"
)
def block_prefix_sums(spark, sf_dir):
    return S.prefix_sums(blocks(spark, sf_dir))


@register(
    ", t AS (SELECT block_id // 64 AS frame, block_id % 64 AS b, y, x, px[8 * y + x + 1]::BIGINT AS v FROM blocks, (SELECT unnest([0, 4]) AS y), (SELECT unnest([0, 4]) AS x)), p AS (SELECT frame, (b // 8) * 2 + y // 4 AS y, (b % 8) * 2 + x // 4 AS x, v FROM t), "
    "e AS (SELECT p.frame, p.v, abs(p.v - l.v) AS l, abs(p.v - a.v) AS a FROM p LEFT JOIN p l ON l.frame = p.frame AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN p a ON a.frame = p.frame AND a.x = p.x AND a.y = p.y - 1), "
    "g AS (SELECT frame, count(DISTINCT v) AS n_values, (max(v) - min(v))::BIGINT AS range, CASE WHEN count(l) + count(a) = 0 THEN 0 ELSE (coalesce(sum(l), 0) + coalesce(sum(a), 0))::BIGINT * 256 // (count(l) + count(a)) END::BIGINT AS gradient FROM e GROUP BY frame) SELECT *, n_values <= 8 OR range <= 8 OR (n_values <= 16 AND gradient <= 192) AS simple FROM g"
)
def frame_simple_regions(spark, sf_dir):
    return S.simple_regions(blocks(spark, sf_dir))


@register(
    ", r AS (SELECT a.block_id // 3 AS picture, a.px AS r, b.px AS g, c.px AS b FROM blocks a JOIN blocks b ON b.block_id = a.block_id + 1 JOIN blocks c ON c.block_id = a.block_id + 2 WHERE a.block_id % 3 = 0), u AS (SELECT picture, i, r[i + 1]::BIGINT AS r, g[i + 1]::BIGINT AS g, b[i + 1]::BIGINT AS b FROM (SELECT *, unnest(range(64)) AS i FROM r)) "
    "SELECT picture, sum(r * (3 * i + 1) + g * (3 * i + 2) + b * (3 * i + 3))::BIGINT AS packed_sum, sum(g * (i + 1) + b * (i + 65) + r * (i + 129))::BIGINT AS planar_sum, true AS lossless FROM u GROUP BY picture"
)
def frame_rgb_planes(spark, sf_dir):
    return S.rgb_planes(blocks(spark, sf_dir))


@register("SELECT block_id, len(list_distinct(px))::BIGINT AS n_colours, len(list_distinct(px)) BETWEEN 2 AND 4 AS palette_worthy, list_max(px) = 0 AS black, sha256(unhex(array_to_string(list_transform(px, lambda v: printf('%02x', v)), ''))) AS digest FROM blocks")
def block_predicates(spark, sf_dir):
    """Whether a block is worth a palette (2 to 4 distinct samples, unquantized) or black, and the digest of its bytes."""
    n = F.size(F.array_distinct("px")).cast("long")
    return blocks(spark, sf_dir).select("block_id", n.alias("n_colours"), n.between(2, 4).alias("palette_worthy"), (F.array_max("px") == 0).alias("black"), F.sha2(F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")), 256).alias("digest"))


@register(
    "SELECT l_linenumber::BIGINT AS key, count(*) AS n, CASE WHEN bool_and(l_discount = 0) THEN 'inf'::DOUBLE WHEN bool_or(l_discount = 0) THEN NULL ELSE avg(l_quantity) END AS mean FROM lineitem GROUP BY 1 UNION ALL SELECT 100 + l_shipmode_, count(*), CASE WHEN bool_and(l_discount = 0) THEN 'inf'::DOUBLE WHEN bool_or(l_discount = 0) THEN NULL ELSE avg(l_quantity) END FROM (SELECT *, floor(l_discount * 100 + 0.5)::BIGINT AS l_shipmode_ FROM lineitem) GROUP BY 1"
)
def report_psnr_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("x")
    both = li.select(F.col("l_linenumber").cast("long").alias("key"), x).union(li.select(100 + F.floor(F.col("l_discount") * 100 + 0.5), x))
    return R.psnr_mean(both, "key", "x")


@register(
    """, cell AS (SELECT "case", source, frame, sb_x, sb_y, sum(bits)::BIGINT AS bits FROM sb GROUP BY ALL), matched AS (SELECT "case", frame, sb_x, sb_y FROM cell WHERE source = 'F' INTERSECT SELECT "case", frame, sb_x, sb_y FROM cell WHERE source = 'O')
    SELECT "case", source, count(*) AS cells, count(m.frame) AS matched, sum(bits)::BIGINT AS bits, coalesce(sum(bits) FILTER (m.frame IS NOT NULL), 0)::BIGINT AS matched_bits FROM cell LEFT JOIN matched m USING ("case", frame, sb_x, sb_y) GROUP BY "case", source"""
)
def trace_matched_keys(spark, sf_dir):
    return R.matched_keys(superblocks(spark, sf_dir), "F", "O")


@register('SELECT "case", frame, count(*) AS n, sum(bits)::BIGINT AS bits FROM sb WHERE frame <= 3 GROUP BY ALL')
def trace_frame_limit(spark, sf_dir):
    return R.first_frames(superblocks(spark, sf_dir), 3)


@register(
    r"""SELECT doc_id, coalesce(list_filter(l, lambda x: contains(x, 'error:') OR contains(x, 'Error:') OR contains(x, 'panic') OR contains(x, 'FAIL:'))[1], list_filter(l, lambda x: x <> '')[-1], 'encoder command failed') AS reason
    FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS l FROM documents)"""
)
def log_failure_reasons(spark, sf_dir):
    return R.failure_reasons(table(spark, sf_dir, "documents"), "doc_id", "text")


@register(
    "SELECT p_partkey AS id, CASE WHEN k IN (0, 1, 2) THEN p_size::BIGINT * 2 END AS width, CASE WHEN k IN (0, 1, 2) THEN (p_partkey % 90 + 1)::BIGINT END AS height, CASE k WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'gray10' WHEN 2 THEN 'gbrp' END AS format, CASE k WHEN 0 THEN 30 WHEN 1 THEN 2997 WHEN 2 THEN 30000 END::BIGINT AS fps_num, CASE k WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 1001 END::BIGINT AS fps_den, CASE WHEN p_size BETWEEN 1 AND 255 THEN p_size::BIGINT END AS qp FROM (SELECT *, p_partkey % 4 AS k FROM part)"
)
def format_specs(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "YUV420p").when(k == 1, "gray10").when(k == 2, "gbrp").otherwise("")
    video = F.when(k == 3, "1920:yuv").otherwise(F.concat((F.col("p_size") * 2).cast("string"), F.lit("x"), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit(":"), name))
    fps = F.when(k == 0, "30").when(k == 1, "29.97").when(k == 2, "30000/1001").otherwise("1/0")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), video.alias("video"), fps.alias("fps"), F.col("p_size").cast("string").alias("qp"))
    return P.parse_specs(d)


@register(
    ", n AS (SELECT l_partkey AS n, count(*) AS c FROM lineitem GROUP BY 1) SELECT n, c, (n + 7) // 8 * 8 AS canvas, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END::BIGINT AS log2_up, (1::BIGINT << (CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END)) AS power_up, (length(bin(n + 1)) * 2 - 1)::BIGINT AS golomb_bits, (n // 4 + 3)::BIGINT AS rice_bits FROM n"
)
def format_integer_sizes(spark, sf_dir):
    return P.integer_sizes(table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("n")).agg(F.count("*").alias("c")))


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"


@register('SELECT "case", source, count(*) AS n, sum(bits)::BIGINT AS bits, sum(palette_bits)::BIGINT AS palette_bits, 0::BIGINT AS skipped FROM sb GROUP BY ALL')
def source_jsonl_traces(spark, sf_dir):
    """Superblocks written as JSON lines and read back by schema; a field that no line has takes its default."""
    path = _scratch(spark)
    X.write_jsonl(superblocks(spark, sf_dir), path)
    d = X.read_jsonl(spark, path, "`case` string, source string, frame long, bits long, palette_bits long, skipped long", {"skipped": 0})
    return d.groupBy("case", "source").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"), F.sum("palette_bits").alias("palette_bits"), F.sum("skipped").alias("skipped"))


@register("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users, sum(round(value * 100)::BIGINT)::BIGINT AS cents, 0::BIGINT AS frames FROM events GROUP BY 1")
def source_key_value_log(spark, sf_dir):
    """Events written as a key=value log and read back; a key that no line has is null."""
    path = _scratch(spark)
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    X.write_key_values(events, path, ["event_type", "user_id", "cents"])
    d = X.read_key_values(spark, path, {"event_type": "string", "user_id": "long", "cents": "long", "frame": "long"})
    return d.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.sum("cents").alias("cents"), F.count("frame").alias("frames"))


@register("SELECT p_brand AS brand, count(*) AS n, sum(p_size)::BIGINT AS sizes, max(p_name) AS last_name FROM part GROUP BY 1")
def source_csv_manifest(spark, sf_dir):
    path = _scratch(spark)
    X.write_manifest(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    d = X.read_manifest(spark, path, "p_partkey long, p_name string, p_brand string, p_size int")
    return d.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"), F.max("p_name").alias("last_name"))


@register(
    ', t AS (SELECT "case", source, sum(bits)::BIGINT AS bits FROM sb GROUP BY ALL) SELECT 0 AS rank, \'| case | source | bits |\' AS line UNION ALL SELECT 1, \'| --- | --- | --- |\' UNION ALL SELECT 2, \'| \' || "case" || \' | \' || source || \' | \' || bits || \' |\' FROM t'
)
def report_markdown_table(spark, sf_dir):
    """A whole table with head and rule, the largest bits first."""
    d = superblocks(spark, sf_dir).groupBy("case", "source").agg(F.sum("bits").alias("bits"))
    return X.markdown_table(d, ["case", "source", "bits"], {"bits": False})


@register("SELECT '| ' || \"case\" || ' | ' || replace(source, '|', '\\|') || ' | ' || sum(bits)::BIGINT::VARCHAR || ' | n/a |' AS line FROM sb GROUP BY \"case\", source")
def report_markdown(spark, sf_dir):
    d = superblocks(spark, sf_dir).groupBy("case", "source").agg(F.sum("bits").alias("bits")).withColumn("delta", F.lit(None).cast("long"))
    return X.markdown_rows(d, ["case", "source", "bits", "delta"])
