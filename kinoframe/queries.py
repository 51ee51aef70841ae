"""The registered queries on traces and blocks, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks as B
from .operators import traces as T
from .plans.bridges import BLOCKS_SQL, CATEGORIES, SUPERBLOCKS_SQL, blocks, superblocks, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH RECURSIVE sb AS ({SUPERBLOCKS_SQL}), blocks AS ({BLOCKS_SQL}) {sql}"
        return f

    return add


@register(
    'SELECT "case", source, frame, count(*) AS n, sum(bits)::BIGINT AS total_bits, avg(bits) AS mean_bits, quantile_disc(bits, 0.95) AS p95_bits, max(bits) AS max_bits, array_to_string(list_transform(list_sort(['
    + ", ".join(f"{{'less': -sum({c})::BIGINT, 'name': '{c}'}}" for c in CATEGORIES)
    + "])[1:3], lambda t: concat(t.name, '=', -t.less)), ', ') AS top_categories FROM sb GROUP BY \"case\", source, frame"
)
def trace_superblock_summary(spark, sf_dir):
    return T.superblock_summary(superblocks(spark, sf_dir))


@register(
    ', sums AS (SELECT "case", source, sum(bits) AS total, ' + ", ".join(f"sum({c}) AS {c}" for c in CATEGORIES) + ' FROM sb GROUP BY ALL), long AS ('
    + " UNION ALL ".join(f"SELECT \"case\", source, '{c}' AS category, {c}::BIGINT AS category_bits, greatest(total, {' + '.join(CATEGORIES)}) AS whole FROM sums" for c in CATEGORIES)
    + ') SELECT "case", source, category, category_bits, category_bits / whole AS share, row_number() OVER (PARTITION BY "case", source ORDER BY category_bits DESC, category) AS rank FROM long QUALIFY rank <= 3'
)
def trace_category_rollup(spark, sf_dir):
    return T.category_rollup(superblocks(spark, sf_dir))


@register(
    """, cell AS (SELECT "case", source, frame, sb_x, sb_y, sum(bits)::BIGINT AS bits FROM sb GROUP BY ALL), both_ AS (
    SELECT o."case", o.source, o.frame, o.sb_x, o.sb_y, b.bits AS base_bits, o.bits, o.bits - b.bits AS delta
    FROM cell b JOIN cell o ON b."case" = o."case" AND b.frame = o.frame AND b.sb_x = o.sb_x AND b.sb_y = o.sb_y WHERE b.source = 'F' AND o.source <> 'F'
), worst AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY "case", source, frame ORDER BY delta DESC, sb_y, sb_x) = 1)
SELECT t.*, w.delta AS worst_delta, w.sb_x AS worst_x, w.sb_y AS worst_y FROM (SELECT "case", source, frame, count(*) AS matched, sum(base_bits)::BIGINT AS base_bits, sum(bits)::BIGINT AS bits, sum(delta)::BIGINT AS delta FROM both_ GROUP BY ALL) t
JOIN worst w USING ("case", source, frame)"""
)
def trace_pairwise(spark, sf_dir):
    return T.pairwise(superblocks(spark, sf_dir), "F")


@register('SELECT "case", source, sb_x, sb_y, sum(bits)::BIGINT AS bits, count(*) AS hits, row_number() OVER (PARTITION BY "case", source ORDER BY sum(bits) DESC, sb_y, sb_x) AS rank FROM sb GROUP BY ALL QUALIFY rank <= 10'.replace("GROUP BY ALL", 'GROUP BY "case", source, sb_x, sb_y'))
def trace_hot_superblocks(spark, sf_dir):
    return T.hot_superblocks(superblocks(spark, sf_dir), 10)


@register("SELECT strftime(ts, '%H') AS phase, event_type AS name, sum(round(value * 100)::BIGINT)::BIGINT AS bits, count(*) AS records FROM events GROUP BY 1, 2")
def trace_field_summary(spark, sf_dir):
    return T.field_summary(table(spark, sf_dir, "events"))


@register("SELECT event_type, key, sum(json_extract_string(props, '$.\"' || key || '\"')::BIGINT)::BIGINT AS total, count(*) AS n FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY 1, 2")
def trace_dynamic_keys(spark, sf_dir):
    return T.dynamic_keys(table(spark, sf_dir, "events"))


@register(
    'SELECT "case", stage, ns, calls, ns / sum(ns) OVER (PARTITION BY "case") AS share, ns / calls AS ns_per_call FROM (SELECT o_orderstatus AS "case", o_orderpriority AS stage, sum(floor(o_totalprice)::BIGINT)::BIGINT AS ns, count(*) AS calls FROM orders GROUP BY 1, 2)'
)
def trace_stage_timing(spark, sf_dir):
    return T.stage_timing(table(spark, sf_dir, "orders"))


@register(
    "SELECT \"case\", frame, h::BIGINT AS head_bits, t::BIGINT AS tail_bits, CASE WHEN h + t > 0 THEN t / (h + t) END AS tail_share FROM (SELECT \"case\", frame, coalesce(sum(residual_bits) FILTER (source = 'F'), 0) AS h, coalesce(sum(residual_bits) FILTER (source = 'O'), 0) AS t FROM sb GROUP BY 1, 2)"
)
def trace_tail_pivot(spark, sf_dir):
    return T.tail_pivot(superblocks(spark, sf_dir))


@register('SELECT "case", source, sum(bits)::BIGINT AS bits, sum(frame)::BIGINT AS frames, grouping("case", source)::BIGINT AS level, sum(bits) / sum(frame) AS bits_per_frame FROM sb GROUP BY ROLLUP ("case", source)')
def report_matrix_totals(spark, sf_dir):
    return T.matrix_totals(superblocks(spark, sf_dir))


_CELLS = 'SELECT "case", frame, sb_x, sum(bits)::BIGINT AS bits FROM sb'


@register(f", now AS ({_CELLS} WHERE source = 'O' GROUP BY ALL), old AS ({_CELLS} WHERE source = 'F' AND sb_y < 5 GROUP BY ALL) SELECT n.*, n.bits - o.bits AS delta_bits FROM now n LEFT JOIN old o USING (\"case\", frame, sb_x)")
def report_baseline_delta(spark, sf_dir):
    sb, keys = superblocks(spark, sf_dir), ["case", "frame", "sb_x"]
    sums = lambda d: d.groupBy(*keys).agg(F.sum("bits").alias("bits"))
    return T.baseline_delta(sums(sb.where("source = 'O'")), sums(sb.where("source = 'F' and sb_y < 5")), keys)


@register("SELECT codec, count(*) FILTER (only_ IS NULL OR only_ = codec) AS enabled, count(*) FILTER (NOT (only_ IS NULL OR only_ = codec)) AS skipped FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'av2' WHEN p_size % 3 = 1 THEN 'vvc' END AS only_ FROM part), (VALUES ('av2'), ('vvc')) c(codec) GROUP BY codec")
def report_enabled_cases(spark, sf_dir):
    size = F.col("p_size") % 3
    parts = table(spark, sf_dir, "part").select(F.when(size == 0, "av2").when(size == 1, "vvc").alias("only"))
    return T.enabled_cases(parts, spark.createDataFrame([("av2",), ("vvc",)], "codec string"))


@register("SELECT l_shipmode_ AS key, count(*) FILTER (x = 'inf'::DOUBLE) AS n_infinite, avg(CASE WHEN x <> 'inf'::DOUBLE THEN x END) AS finite_mean, bool_and(x = 'inf'::DOUBLE) AS all_infinite FROM (SELECT l_linenumber::BIGINT AS l_shipmode_, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_quantity END AS x FROM lineitem) GROUP BY 1")
def report_infinite_mean(spark, sf_dir):
    x = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return T.infinite_mean(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("key"), x.alias("x")), "key", "x")


_PAIRS = ", p AS (SELECT a.block_id, a.label, list_transform(range(1, 65), lambda i: (a.px[i] - b.px[i])::BIGINT) AS d FROM blocks a JOIN blocks b ON a.block_id = b.block_id + 64), e AS (SELECT block_id, label, list_sum(list_transform(d, lambda x: abs(x)))::BIGINT AS sad, list_sum(list_transform(d, lambda x: x * x))::BIGINT AS sse FROM p)"


@register(_PAIRS + " SELECT *, CASE WHEN sse > 0 THEN round(10 * log10(255.0 * 255 * 64 / sse), 6) END AS psnr FROM e")
def block_errors(spark, sf_dir):
    return B.errors(B.previous(blocks(spark, sf_dir)))


@register(_PAIRS + " SELECT label, count(*) AS n, sum(sse)::BIGINT AS sse, CASE WHEN sum(sse) > 0 THEN round(10 * log10(255.0 * 255 * 64 * count(*) / sum(sse)), 6) END AS psnr FROM e GROUP BY label")
def block_pooled_psnr(spark, sf_dir):
    return B.pooled_psnr(B.previous(blocks(spark, sf_dir)))


@register(
    ", s AS (SELECT block_id, (i // 32) * 2 + (i % 8) // 4 AS q, px[i + 1]::BIGINT AS v FROM (SELECT block_id, px, unnest(range(64)) AS i FROM blocks)), w AS (SELECT block_id, sum((v - m) * (v - m))::BIGINT AS whole_sse FROM (SELECT *, (sum(v) OVER (PARTITION BY block_id) + 32) // 64 AS m FROM s) GROUP BY 1), f AS (SELECT block_id, sum((v - m) * (v - m))::BIGINT AS split_sse FROM (SELECT *, (sum(v) OVER (PARTITION BY block_id, q) + 8) // 16 AS m FROM s) GROUP BY 1) SELECT block_id, whole_sse, split_sse, whole_sse - split_sse AS gain, CASE WHEN whole_sse > split_sse THEN 4 ELSE 8 END::BIGINT AS side FROM w JOIN f USING (block_id)"
)
def block_split_gain(spark, sf_dir):
    return B.split_gain(blocks(spark, sf_dir))


@register("SELECT block_id, len(list_distinct(px))::BIGINT AS n_colours, (list_max(px) - list_min(px))::BIGINT AS range, len(list_distinct(px)) BETWEEN 2 AND 4 AS palette_worthy FROM blocks")
def block_palettes(spark, sf_dir):
    return B.palettes(blocks(spark, sf_dir))


@register("SELECT label, v::BIGINT AS v, count(*) AS n, min(block_id * 64 + i) AS first_at FROM (SELECT label, block_id, unnest(px) AS v, unnest(range(64)) AS i FROM blocks) GROUP BY 1, 2")
def block_histogram(spark, sf_dir):
    return B.histogram(blocks(spark, sf_dir))


@register("SELECT block_id, list_sum(x)::BIGINT AS total, list_max(x)::BIGINT AS largest FROM (SELECT block_id, list_transform(px, lambda s: (s::BIGINT * 1023 + 127) // 255) AS x FROM blocks)")
def block_depth_10(spark, sf_dir):
    return B.rescale_depth(blocks(spark, sf_dir), 10)


@register(
    ", s AS (SELECT block_id, q, i // 4 AS y, i % 4 AS x, px[8 * (4 * (q // 2) + i // 4) + 4 * (q % 2) + i % 4 + 1]::BIGINT AS p FROM blocks, (SELECT unnest(range(4)) AS q), (SELECT unnest(range(16)) AS i)), t AS (SELECT block_id, q, u, v, sum(p * CASE WHEN (bit_count(u & y) + bit_count(v & x)) % 2 = 1 THEN -1 ELSE 1 END)::BIGINT AS c FROM s, (SELECT unnest(range(4)) AS u), (SELECT unnest(range(4)) AS v) GROUP BY ALL), k AS (SELECT block_id, q AS quarter, (sum(c) FILTER (u = 0 AND v = 0))::BIGINT AS dc, coalesce(sum(abs(c)) FILTER (u > 0 OR v > 0), 0)::BIGINT AS ac FROM t GROUP BY 1, 2) SELECT block_id, sum(dc)::BIGINT AS dc, sum(ac)::BIGINT AS ac FROM k GROUP BY 1"
)
def block_walsh_hadamard(spark, sf_dir):
    return B.walsh_hadamard(blocks(spark, sf_dir))


@register(", d AS (SELECT block_id, list_transform(px, lambda x: x // 96) AS g FROM blocks), f AS (SELECT g, min(block_id) AS match_id FROM d GROUP BY g) SELECT block_id, match_id, block_id - match_id AS distance FROM d JOIN f USING (g) WHERE match_id < block_id")
def block_coarse_matches(spark, sf_dir):
    return B.coarse_matches(blocks(spark, sf_dir), 96)


@register(
    ", s AS (SELECT block_id, q, i // 4 AS y, i % 4 AS x, px[8 * (4 * (q // 2) + i // 4) + 4 * (q % 2) + i % 4 + 1]::BIGINT AS p FROM blocks, (SELECT unnest(range(4)) AS q), (SELECT unnest(range(16)) AS i)), t AS (SELECT block_id, q, u, v, sum(p * CASE WHEN (bit_count(u & y) + bit_count(v & x)) % 2 = 1 THEN -1 ELSE 1 END)::BIGINT AS c FROM s, (SELECT unnest(range(4)) AS u), (SELECT unnest(range(4)) AS v) GROUP BY ALL) SELECT block_id, q AS quarter, (sum(c) FILTER (u = 0 AND v = 0))::BIGINT AS dc, coalesce(sum(abs(c)) FILTER (u > 0 OR v > 0), 0)::BIGINT AS ac FROM t GROUP BY 1, 2"
)
def block_walsh_hadamard_quarters(spark, sf_dir):
    return B.walsh_hadamard_quarters(blocks(spark, sf_dir))


@register(", f AS (SELECT px, min(block_id) AS match_id FROM blocks GROUP BY px) SELECT block_id, match_id, block_id - match_id AS distance FROM blocks JOIN f USING (px) WHERE match_id < block_id")
def block_matches(spark, sf_dir):
    return B.block_matches(blocks(spark, sf_dir))


@register(", r AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY block_id) AS ref FROM blocks) SELECT block_id, label, CASE WHEN ref IS NOT NULL THEN list_sum(list_transform(range(1, 65), lambda i: abs(px[i] - ref[i])))::BIGINT END AS sad FROM r")
def block_change_runs(spark, sf_dir):
    return B.change_runs(blocks(spark, sf_dir))
