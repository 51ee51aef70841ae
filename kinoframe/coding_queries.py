"""The registered queries on prediction, quantization, motion, formats and replay, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import blocks as B
from .operators import coding as C
from .operators import formats
from .operators import traces as T
from .plans.bridges import CATEGORIES, blocks, superblocks, table
from .queries import register
from .streaming import replay

QPS = (12, 18, 24, 30, 36)


@register(
    ", e AS (SELECT m.block_id, m.px, a.px[57:64] AS a, list_transform(range(8), lambda y: l.px[8 * y + 8]) AS l, l.px IS NOT NULL AS hl FROM blocks m LEFT JOIN blocks l ON l.block_id + 1 = m.block_id AND m.block_id % 8 > 0 LEFT JOIN blocks a ON a.block_id + 8 = m.block_id AND m.block_id % 64 >= 8),"
    " d AS (SELECT block_id, px, CASE WHEN a IS NOT NULL AND hl THEN (list_sum(a) + list_sum(l) + 8)::BIGINT // 16 WHEN a IS NOT NULL THEN (list_sum(a) + 4)::BIGINT // 8 WHEN hl THEN (list_sum(l) + 4)::BIGINT // 8 ELSE 128 END AS dc, CASE WHEN a IS NOT NULL THEN a ELSE list_transform(range(8), lambda i: 127) END AS a, CASE WHEN hl THEN l ELSE list_transform(range(8), lambda i: 129) END AS l FROM e),"
    " s AS (SELECT block_id, dc, list_sum(list_transform(px, lambda v: abs(v - dc)))::BIGINT AS dc_sad, list_sum(list_transform(range(64), lambda i: abs(px[i + 1] - l[i // 8 + 1])))::BIGINT AS h_sad, list_sum(list_transform(range(64), lambda i: abs(px[i + 1] - a[i % 8 + 1])))::BIGINT AS v_sad FROM d)"
    " SELECT *, CASE WHEN dc_sad <= h_sad AND dc_sad <= v_sad THEN 'dc' WHEN h_sad <= v_sad THEN 'h' ELSE 'v' END AS mode FROM s"
)
def block_edge_predictors(spark, sf_dir):
    return C.edge_predictors(blocks(spark, sf_dir))


@register(
    ", s AS (SELECT block_id, px[i + 1] AS p, px[i] AS l, px[i - 7] AS a, px[i - 8] AS k FROM (SELECT block_id, px, unnest(range(64)) AS i FROM blocks) WHERE i >= 8 AND i % 8 > 0)"
    " SELECT block_id, sum(abs(p - CASE WHEN abs(a - k) <= abs(l - k) AND abs(a - k) <= abs(l + a - 2 * k) THEN l WHEN abs(l - k) <= abs(l + a - 2 * k) THEN a ELSE k END))::BIGINT AS paeth_sad FROM s GROUP BY 1"
)
def block_paeth(spark, sf_dir):
    return C.paeth(blocks(spark, sf_dir))


@register(
    ", s AS (SELECT block_id, (sum(abs(px[i + 1] - px[i])) FILTER (i % 8 > 0))::BIGINT AS h_cost, (sum(abs(px[i + 1] - px[i - 7])) FILTER (i >= 8))::BIGINT AS v_cost FROM (SELECT block_id, px, unnest(range(64)) AS i FROM blocks) GROUP BY 1) SELECT *, CASE WHEN h_cost <= v_cost THEN 'h' ELSE 'v' END AS direction FROM s"
)
def block_dpcm(spark, sf_dir):
    return C.dpcm(blocks(spark, sf_dir))


_RESIDUAL = ", p AS (SELECT a.block_id, list_transform(range(1, 65), lambda i: (a.px[i] - b.px[i])::BIGINT) AS r FROM blocks a JOIN blocks b ON a.block_id = b.block_id + 64)"


@register(
    f"{_RESIDUAL}, s AS (SELECT block_id, qp::BIGINT AS qp, (1::BIGINT << (qp // 6)) AS step, unnest(r) AS r FROM p, (SELECT unnest({list(QPS)}) AS qp)), l AS (SELECT *, sign(r)::BIGINT * ((abs(r) + step // 2) // step) AS level FROM s),"
    " c AS (SELECT block_id, qp, sum((r - level * step) * (r - level * step))::BIGINT AS sse, sum(2 * length(bin(2 * abs(level) + CASE WHEN level > 0 THEN 0 ELSE 1 END)) - 1)::BIGINT AS bits, any_value(step) AS step FROM l GROUP BY 1, 2)"
    " SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY sse + step * bits, qp) AS rank, sse + step * bits AS score, qp, sse, bits FROM c QUALIFY rank <= 2"
)
def block_rate_distortion(spark, sf_dir):
    return C.rate_distortion(B.previous(blocks(spark, sf_dir)), QPS, 2)


@register(f"{_RESIDUAL}, e AS (SELECT block_id, unnest(r) AS r, unnest(range(64)) AS i FROM p) SELECT block_id, sum(r * r)::BIGINT AS energy, (sum(r * r) FILTER (i < 32 AND i % 8 < 4))::BIGINT AS head, (sum(r * r) FILTER (NOT (i < 32 AND i % 8 < 4)))::BIGINT AS tail FROM e GROUP BY 1")
def block_energy_split(spark, sf_dir):
    return C.energy_split(B.previous(blocks(spark, sf_dir)))


@register("SELECT block_id, (64 * sum(v * v) - sum(v) * sum(v))::BIGINT // 4096 AS variance FROM (SELECT block_id, unnest(px)::BIGINT AS v FROM blocks) GROUP BY 1")
def block_variance(spark, sf_dir):
    return C.variance(blocks(spark, sf_dir))


@register(
    ", s AS (SELECT block_id, i, px[8 * (i // 8) + CASE WHEN i // 8 % 2 = 0 THEN i % 8 ELSE 7 - i % 8 END + 1] // 64 AS v FROM (SELECT block_id, px, unnest(range(64)) AS i FROM blocks)), c AS (SELECT block_id, v IS DISTINCT FROM lag(v) OVER (PARTITION BY block_id ORDER BY i) AS new FROM s) SELECT block_id, count(*) FILTER (new) AS runs FROM c GROUP BY 1"
)
def block_index_runs(spark, sf_dir):
    return C.index_runs(B.quantized(blocks(spark, sf_dir), 64))


@register(
    ", r AS (SELECT block_id, y, list_transform(px[8 * y + 1 : 8 * y + 8], lambda x: x // 128) AS v FROM (SELECT block_id, px, unnest(range(8)) AS y FROM blocks)), f AS (SELECT block_id, y, CASE WHEN v = lag(v) OVER (PARTITION BY block_id ORDER BY y) THEN '2' WHEN len(list_distinct(v)) = 1 THEN '1' ELSE '0' END AS f FROM r) SELECT block_id, string_agg(f, '' ORDER BY y) AS flags FROM f GROUP BY 1"
)
def block_row_identity(spark, sf_dir):
    return C.row_identity(B.quantized(blocks(spark, sf_dir), 128))


@register(
    ", s AS (SELECT block_id, v, min(i) AS first, count(*) AS n FROM (SELECT block_id, unnest(px) // 16 AS v, unnest(range(64)) AS i FROM blocks) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY first) AS k FROM s) SELECT block_id, string_agg(v::VARCHAR, ',' ORDER BY k) FILTER (k <= 6) AS palette, coalesce(sum(n) FILTER (k > 6), 0)::BIGINT AS escaped FROM k GROUP BY 1"
)
def block_first_seen_palette(spark, sf_dir):
    return C.first_seen_palette(B.quantized(blocks(spark, sf_dir), 16), 6)


_MOTION = (
    ", pl AS (SELECT block_id, block_id // 64 AS frame, block_id % 64 // 8 AS r, block_id % 8 AS c, list_transform(px, lambda x: x // 96) AS sig FROM blocks),"
    " pairs AS (SELECT n.block_id, n.frame, n.r, n.c, p.r AS pr, p.c AS pc FROM pl n JOIN pl p ON p.frame = n.frame - 1 AND p.sig = n.sig),"
    " mv AS (SELECT block_id, frame, count(*) OVER (PARTITION BY block_id) AS candidates, pr - r AS mv_row, pc - c AS mv_col FROM pairs QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY abs(pr - r) + abs(pc - c), pr, pc) = 1)"
)


@register(f"{_MOTION} SELECT * FROM mv")
def block_motion_matches(spark, sf_dir):
    return C.motion_matches(blocks(spark, sf_dir), 96)


@register(
    f"{_MOTION}, t AS (SELECT frame, count(*) AS n_blocks, count(mv_row) AS matched, count(*) FILTER (mv_row = 0 AND mv_col = 0) AS still, count(DISTINCT (mv_row, mv_col)) FILTER (mv_row IS NOT NULL) AS motions FROM pl LEFT JOIN (SELECT block_id, mv_row, mv_col FROM mv) USING (block_id) GROUP BY 1)"
    " SELECT *, CASE WHEN still = n_blocks THEN 'unchanged' WHEN matched = n_blocks AND motions = 1 THEN 'motion' WHEN matched = n_blocks THEN 'mixed' WHEN matched > 0 THEN 'partial' ELSE 'intra' END AS mode FROM t"
)
def block_frame_modes(spark, sf_dir):
    return C.frame_modes(blocks(spark, sf_dir), 96)


@register(", s AS (SELECT block_id, label, list_transform(px, lambda x: x // 96) AS s FROM blocks), b AS (SELECT *, lag(s) OVER (PARTITION BY label ORDER BY block_id) AS b FROM s) SELECT block_id, label, CASE WHEN b IS NULL THEN 'key' WHEN b = s THEN 'existing' ELSE 'inter' END AS kind FROM b")
def block_frame_kinds(spark, sf_dir):
    return C.frame_kinds(blocks(spark, sf_dir), 96)


@register(", b AS (SELECT *, lag(px) OVER (PARTITION BY label ORDER BY block_id) AS b FROM blocks) SELECT block_id, label, CASE WHEN b IS NULL THEN 'key' WHEN b = px THEN 'existing' ELSE 'inter' END AS kind FROM b")
def block_frame_kinds_whole(spark, sf_dir):
    return C.frame_kinds(blocks(spark, sf_dir), None)


_WHOLE_MOTION = (
    ", pl AS (SELECT block_id, block_id // 64 AS frame, block_id % 64 // 8 AS r, block_id % 8 AS c, px AS sig FROM blocks), pairs AS (SELECT n.block_id, n.frame, n.r, n.c, p.r AS pr, p.c AS pc FROM pl n JOIN pl p ON p.frame = n.frame - 1 AND p.sig = n.sig),"
    " mv AS (SELECT block_id, frame, count(*) OVER (PARTITION BY block_id) AS candidates, pr - r AS mv_row, pc - c AS mv_col FROM pairs QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY abs(pr - r) + abs(pc - c), pr, pc) = 1)"
)


@register(f"{_WHOLE_MOTION} SELECT * FROM mv")
def block_motion_matches_whole(spark, sf_dir):
    return C.motion_matches(blocks(spark, sf_dir), None)


@register(
    f"{_WHOLE_MOTION}, t AS (SELECT frame, count(*) AS n_blocks, count(mv_row) AS matched, count(*) FILTER (mv_row = 0 AND mv_col = 0) AS still, count(DISTINCT (mv_row, mv_col)) FILTER (mv_row IS NOT NULL) AS motions FROM pl LEFT JOIN (SELECT block_id, mv_row, mv_col FROM mv) USING (block_id) GROUP BY 1)"
    " SELECT *, CASE WHEN still = n_blocks THEN 'unchanged' WHEN matched = n_blocks AND motions = 1 THEN 'motion' WHEN matched = n_blocks THEN 'mixed' WHEN matched > 0 THEN 'partial' ELSE 'intra' END AS mode FROM t"
)
def block_frame_modes_whole(spark, sf_dir):
    return C.frame_modes(blocks(spark, sf_dir), None)


#: Fixed names that format parsing meets, valid and invalid.
NAMES = ("yuv420p", "YUV422P10LE", " yuv444p12le ", "gray8", "y10le", "rgb24", "yuv420p16be", "yuv420p17le", "yuv422p9", "gbrp")
_FRAMES = f"SELECT p_partkey AS id, ({list(NAMES)})[p_partkey % {len(NAMES)} + 1] AS name, (p_size * 7 % 333)::BIGINT AS width, (p_size * 5 + 9)::BIGINT AS height FROM part"


def frames(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), (F.col("p_size") * 7 % 333).cast("long").alias("width"), (F.col("p_size") * 5 + 9).cast("long").alias("height"))


@register(
    f", fr AS (SELECT *, lower(trim(name)) AS f FROM ({_FRAMES})), a AS (SELECT *, CASE WHEN f = 'rgb24' THEN 'rgb' WHEN f IN ('gbrp', 'gbrp8') THEN 'gbr' WHEN f ~ '^(gray|y)[0-9]*(le)?$' THEN '400' WHEN f ~ '^yuv4(20|22|44)p([0-9]+(le)?)?$' THEN f[4:6] END AS s, regexp_extract(f, '^(gray|y|yuv[0-9]+p)([0-9]+)', 2) AS digits FROM fr),"
    " b AS (SELECT *, CASE WHEN digits = '' THEN 8 ELSE digits::BIGINT END AS d FROM a), c AS (SELECT * REPLACE (CASE WHEN d BETWEEN 8 AND 16 THEN s END AS s) FROM b)"
    " SELECT id, s AS sampling, CASE WHEN s IS NOT NULL THEN d END AS depth, CASE s WHEN 'rgb' THEN 'rgb24' WHEN 'gbr' THEN 'gbrp8' WHEN '400' THEN 'gray' || d || CASE WHEN d > 8 THEN 'le' ELSE '' END ELSE 'yuv' || s || 'p' || d || CASE WHEN d > 8 THEN 'le' ELSE '' END END AS canonical,"
    " CASE WHEN s IS NOT NULL THEN CASE WHEN d > 8 THEN 2 ELSE 1 END * CASE s WHEN '400' THEN width * height WHEN '420' THEN width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2) WHEN '422' THEN width * height + 2 * ((width + 1) // 2) * height ELSE 3 * width * height END END::BIGINT AS frame_bytes,"
    " CASE WHEN s IS NOT NULL THEN CASE WHEN d > 8 THEN 2 ELSE 1 END * width * height END::BIGINT AS luma_bytes, CASE WHEN s IS NOT NULL THEN CASE WHEN d > 8 THEN 2 ELSE 1 END * CASE s WHEN '400' THEN 0 WHEN '420' THEN ((width + 1) // 2) * ((height + 1) // 2) WHEN '422' THEN ((width + 1) // 2) * height WHEN 'rgb' THEN 0 ELSE width * height END END::BIGINT AS chroma_bytes, s IS NOT NULL AND width > 0 AND height > 0 AND CASE s WHEN '420' THEN width % 2 = 0 AND height % 2 = 0 WHEN '422' THEN width % 2 = 0 ELSE true END AS valid FROM c"
)
def format_geometry(spark, sf_dir):
    return formats.geometry(frames(spark, sf_dir))


@register(
    f", g AS (SELECT *, unnest(range((height + 63) // 64)) AS r FROM ({_FRAMES})), h AS (SELECT *, unnest(range((width + 63) // 64)) AS c FROM g) SELECT id, r * ((width + 63) // 64) + c AS region, 64 * c AS x, 64 * r AS y, least(64, width - 64 * c)::BIGINT AS w, least(64, height - 64 * r)::BIGINT AS h FROM h"
)
def format_regions(spark, sf_dir):
    return formats.regions(frames(spark, sf_dir))


@register("SELECT l_quantity::BIGINT AS qp, count(*) AS n, least((10 * l_quantity::BIGINT + 2) // 3, 255) AS q_index, 1::BIGINT << (least(l_quantity::BIGINT, 63) // 6) AS lambda, least(l_quantity::BIGINT, 63) AS clamped FROM lineitem GROUP BY ALL")
def format_quantizers(spark, sf_dir):
    return formats.quantizers(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("qp")))


@register(
    ', s AS (SELECT "case", source, count(DISTINCT frame) AS frames, ' + ", ".join(f"sum({c})::BIGINT AS {c}" for c in CATEGORIES) + ' FROM sb GROUP BY ALL) '
    + " UNION ALL ".join(f"SELECT \"case\", source, '{c}' AS counter, {c} AS total, {c} / frames AS per_frame FROM s" for c in CATEGORIES)
)
def trace_counters(spark, sf_dir):
    return T.counters(superblocks(spark, sf_dir))


@register(
    ", c AS (SELECT \"case\", coalesce(sum(bits) FILTER (source = 'F'), 0)::BIGINT AS base_bits, coalesce(sum(bits) FILTER (source = 'O'), 0)::BIGINT AS bits FROM sb GROUP BY GROUPING SETS ((\"case\"), ())) SELECT *, CASE WHEN base_bits > 0 THEN bits / base_bits END AS ratio FROM c"
)
def report_grand_total(spark, sf_dir):
    return T.grand_total(superblocks(spark, sf_dir), "F", "O")


@register("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_hourly_events(spark, sf_dir):
    table(spark, sf_dir, "events")
    return replay.hourly_replay(spark, sf_dir, "events.parquet")
