"""The registered queries on block and tile layout, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import layout as L
from .plans.bridges import CATEGORIES, blocks, superblocks, table
from .queries import register

_PLACED = ", pl AS (SELECT block_id, block_id // 64 AS frame, block_id % 64 // 8 AS row, block_id % 8 AS col, px FROM blocks)"


@register(
    " SELECT block_id, list_reduce(list_transform(px, lambda v: v::BIGINT), lambda h, v: xor(xor(xor(xor(h, v), (xor(h, v) << 13) & 4294967295), xor(xor(h, v), (xor(h, v) << 13) & 4294967295) >> 17),"
    " (xor(xor(xor(h, v), (xor(h, v) << 13) & 4294967295), xor(xor(h, v), (xor(h, v) << 13) & 4294967295) >> 17) << 5) & 4294967295), 2166136261::BIGINT) AS hash FROM blocks"
)
def block_shift_hashes(spark, sf_dir):
    return blocks(spark, sf_dir).select("block_id", L.shift_hash(F.col("px")).alias("hash"))


_TURN5, _TURN13 = ((f"((({{v}}) << {k}) & 4294967295) | (({{v}}) >> {32 - k})") for k in (5, 13))


@register(
    ", p AS (SELECT a.block_id // 3 AS picture, list_transform(a.px || b.px || c.px, lambda v: v::BIGINT) AS s FROM blocks a JOIN blocks b ON b.block_id = a.block_id + 1 JOIN blocks c ON c.block_id = a.block_id + 2 WHERE a.block_id % 3 = 0),"
    " r AS (SELECT picture, list_transform(range(24), lambda i: xor(s[8 * i + 1] + s[8 * i + 2] * 256 + s[8 * i + 3] * 65536 + s[8 * i + 4] * 16777216, xor("
    + _TURN5.format(v="s[8 * i + 5] + s[8 * i + 6] * 256 + s[8 * i + 7] * 65536 + s[8 * i + 8] * 16777216")
    + ", (i // 8) * 1024 + (i % 8) * 128 + 8))) AS m FROM p)"
    f" SELECT picture, list_reduce(m, lambda h, v: xor(xor(xor(h, v), {_TURN13.format(v='xor(h, v)')}), xor((xor(h, v) << 7) & 4294967295, xor(h, v) >> 11)), 2166136261::BIGINT) AS hash FROM r"
)
def block_packet_hashes(spark, sf_dir):
    """The hash of three blocks in a row as the planes of one."""
    b = blocks(spark, sf_dir)
    plane = lambda k, name: b.where(F.col("block_id") % 3 == k).select(F.floor(F.col("block_id") / 3).alias("picture"), F.col("px").alias(name))
    d = plane(0, "y").join(plane(1, "u"), "picture").join(plane(2, "v"), "picture")
    return d.select("picture", L.packet_hash([F.col("y"), F.col("u"), F.col("v")]).alias("hash"))


@register(
    ", pics AS (SELECT p_partkey AS id, p_size * 167 + 8 AS width, p_size * p_partkey % 3000 + 8 AS height FROM part), k AS (SELECT *, (width + 63) // 64 AS c, (height + 63) // 64 AS r FROM pics),"
    " l AS (SELECT *, (SELECT min(i) FROM range(20) t(i) WHERE 64 * 2 ** i >= c) AS min_cols, (SELECT min(i) FROM range(20) t(i) WHERE 2 ** i >= least(c, 64)) AS max_cols, (SELECT min(i) FROM range(20) t(i) WHERE 2 ** i >= least(r, 64)) AS max_rows, (SELECT min(i) FROM range(20) t(i) WHERE 2304 * 2 ** i >= c * r) AS area FROM k),"
    " w AS (SELECT *, greatest(area, min_cols) AS min_log2, least(greatest(CASE WHEN width >= 1920 THEN 2 WHEN width >= 1024 THEN 1 ELSE 0 END, min_cols), max_cols) AS log2_cols FROM l)"
    " SELECT id, width::BIGINT AS width, height::BIGINT AS height, min_cols AS min_log2_cols, max_cols AS max_log2_cols, max_rows AS max_log2_rows, min_log2, log2_cols, least(greatest(CASE WHEN height >= 1080 THEN 1 ELSE 0 END, greatest(min_log2 - log2_cols, 0)), max_rows) AS log2_rows FROM w"
)
def format_fast_tiles(spark, sf_dir):
    """Limits and choice of tiles for pictures up to 8358 samples wide."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return L.fast_tiles(table(spark, sf_dir, "part").select(p.alias("id"), (size * 167 + 8).alias("width"), (size * p % 3000 + 8).alias("height")))


@register(_PLACED + " SELECT block_id, frame, (col % 2 + row % 2 * 2 + col // 2 % 2 * 4 + row // 2 % 2 * 8 + col // 4 * 16 + row // 4 * 32)::BIGINT AS z FROM pl")
def block_leaf_order(spark, sf_dir):
    return L.leaf_order(blocks(spark, sf_dir))


#: A block's mode here: its range of samples in three classes.
_RANGE = "list_max(px) - list_min(px)"


@register(
    _PLACED + f", m AS (SELECT frame, row // 2 AS leaf_row, col // 2 AS leaf_col, CASE WHEN {_RANGE} < 96 THEN 'flat' WHEN {_RANGE} < 128 THEN 'mixed' ELSE 'busy' END AS mode FROM pl)"
    " SELECT frame, leaf_row, leaf_col, CASE WHEN count(*) = 4 AND count(DISTINCT mode) = 1 THEN any_value(mode) END AS mode FROM m GROUP BY ALL"
)
def block_merged_leaves(spark, sf_dir):
    extent = F.array_max("px") - F.array_min("px")
    mode = F.when(extent < 96, "flat").when(extent < 128, "mixed").otherwise("busy")
    return L.merged_leaves(L.placed(blocks(spark, sf_dir)).select("frame", "row", "col", mode.alias("mode")), 2)


@register(
    _PLACED + ", r AS (SELECT p_partkey // 8 AS frame, p_partkey % 5 * 8 AS x0, p_partkey % 7 * 8 AS y0, p_size % 4 * 8 + CASE WHEN p_size = 50 THEN 1 ELSE 0 END AS width, p_size % 5 * 8 AS height FROM part),"
    " g AS (SELECT *, width = 0 OR height = 0 OR (width % 8 = 0 AND x0 + width <= 64 AND y0 + height <= 64) AS good FROM r),"
    " per AS (SELECT frame, count(*) AS n_regions, count(*) FILTER (NOT good) AS n_bad FROM g GROUP BY 1),"
    " c AS (SELECT pl.frame, count(*) AS covered FROM pl WHERE EXISTS (SELECT 1 FROM g WHERE good AND g.frame = pl.frame AND pl.col * 8 >= x0 AND pl.col * 8 < x0 + width AND pl.row * 8 >= y0 AND pl.row * 8 < y0 + height) GROUP BY 1)"
    " SELECT f.frame, coalesce(n_regions, 0) AS n_regions, coalesce(n_bad, 0) AS n_bad, CASE WHEN n_regions IS NULL THEN n_blocks ELSE coalesce(covered, 0) END AS searched"
    " FROM (SELECT frame, count(*) AS n_blocks FROM pl GROUP BY 1) f LEFT JOIN per USING (frame) LEFT JOIN c USING (frame)"
)
def frame_search_masks(spark, sf_dir):
    p, size = F.col("p_partkey"), F.col("p_size")
    width = size % 4 * 8 + F.when(size == 50, 1).otherwise(0)
    regions = table(spark, sf_dir, "part").select(F.floor(p / 8).alias("frame"), (p % 5 * 8).alias("x0"), (p % 7 * 8).alias("y0"), width.alias("width"), (size % 5 * 8).alias("height"))
    return L.search_mask(blocks(spark, sf_dir), regions)


def _side_sql(name: str, size: str, log2: str) -> str:
    """Tiles along one side, counted up superblock by superblock."""
    return (
        f", {name}n AS (SELECT id, {size} AS size, ({size} + 63) // 64 AS n, ({size} + 7) // 8 * 8 // 64 AS full_, (1 << {log2})::BIGINT AS many FROM pics),"
        f" {name}w AS (SELECT *, i, full_ // many + CASE WHEN i < CASE WHEN full_ // many = 0 THEN n ELSE full_ % many END THEN 1 ELSE 0 END AS wide FROM (SELECT *, unnest(range(many)) AS i FROM {name}n)),"
        f" {name}s AS (SELECT *, least(n, sum(wide) OVER (PARTITION BY id ORDER BY i) - wide)::BIGINT AS start FROM {name}w),"
        f" {name} AS (SELECT id, i, size, start, CASE WHEN i = many - 1 THEN n ELSE lead(start) OVER (PARTITION BY id ORDER BY i) END AS stop FROM {name}s)"
    )


@register(
    ", pics AS (SELECT p_partkey AS id, p_size * 37 AS width, p_size * 21 + 5 AS height, p_partkey % 4 AS log2_cols, p_partkey % 3 AS log2_rows FROM part)"
    + _side_sql("tc", "width", "log2_cols")
    + _side_sql("tr", "height", "log2_rows")
    + " SELECT id, tr.i AS tile_row, tc.i AS tile_col, tc.start * 64 AS x, tr.start * 64 AS y, least(tc.stop * 64, tc.size) - tc.start * 64 AS width, least(tr.stop * 64, tr.size) - tr.start * 64 AS height"
    " FROM tc JOIN tr USING (id) WHERE tc.start < tc.stop AND tr.start < tr.stop"
)
def format_tile_layout(spark, sf_dir):
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    return L.tile_layout(table(spark, sf_dir, "part").select(p.alias("id"), (size * 37).alias("width"), (size * 21 + 5).alias("height"), (p % 4).alias("log2_cols"), (p % 3).alias("log2_rows")))


@register(
    ", s AS (SELECT block_id, k // 4 AS y, k % 4 AS x, px FROM (SELECT block_id, px, unnest(range(16)) AS k FROM blocks)),"
    " e AS (SELECT block_id, px[(y + 1) * 8 + x + 2] AS s, px[x + 2] AS top, px[(y + 1) * 8 + 1] AS lef, px[41] AS low, px[6] AS far, [32, 8, 2, 0][y + 1] AS wy, [32, 8, 2, 0][x + 1] AS wx, y, x FROM s),"
    " l AS (SELECT *, low + floor(((top - low) * (3 - y) + 2) / 4.0) AS v0, far + floor(((lef - far) * (3 - x) + 2) / 4.0) AS h0 FROM e),"
    " p AS (SELECT *, v0 + floor(((top - v0) * wy + 32) / 64.0) AS v, h0 + floor(((lef - h0) * wx + 32) / 64.0) AS h FROM l),"
    " d AS (SELECT block_id, sum(abs(s - greatest(0, least(255, floor((v + h + 1) / 2.0)))))::BIGINT AS smooth, sum(abs(s - greatest(0, least(255, v))))::BIGINT AS vertical, sum(abs(s - greatest(0, least(255, h))))::BIGINT AS horizontal FROM p GROUP BY 1)"
    " SELECT *, CASE WHEN smooth <= least(vertical, horizontal) THEN 'smooth' WHEN vertical <= horizontal THEN 'vertical' ELSE 'horizontal' END AS best FROM d"
)
def block_smooth_predictors(spark, sf_dir):
    return L.smooth_errors(blocks(spark, sf_dir))


#: Steps tried in this order.
STEPS = (16, 24, 12, 13, 8)


@register(
    f", c AS (SELECT block_id, k, s, len(list_distinct(list_transform(px, lambda v: v // s)))::BIGINT AS rate, list_sum(list_transform(px, lambda v: (v % s) * (v % s)))::BIGINT AS distortion"
    f" FROM (SELECT block_id, px, unnest(range(1, {len(STEPS) + 1})) AS k, unnest({list(STEPS)}) AS s FROM blocks)),"
    " w AS (WITH RECURSIVE f AS (SELECT block_id, k, s, rate, distortion FROM c WHERE k = 1 UNION ALL SELECT c.block_id, c.k, CASE WHEN t THEN c.s ELSE f.s END, CASE WHEN t THEN c.rate ELSE f.rate END, CASE WHEN t THEN c.distortion ELSE f.distortion END"
    " FROM f JOIN c ON c.block_id = f.block_id AND c.k = f.k + 1, LATERAL (SELECT c.rate <= f.rate AND c.distortion <= f.distortion AND (c.rate < f.rate OR c.distortion < f.distortion) AS t)) SELECT * FROM f)"
    f" SELECT block_id, s::BIGINT AS step, rate, distortion FROM w WHERE k = {len(STEPS)}"
)
def block_dominating_steps(spark, sf_dir):
    return L.step_choice(blocks(spark, sf_dir), STEPS)


@register(
    ", p AS (SELECT *, row_number() OVER (PARTITION BY \"case\", frame, sb_x, sb_y ORDER BY bits, residual_bits, source) AS r, count(*) OVER (PARTITION BY \"case\", frame, sb_x, sb_y) AS n_payloads FROM sb)"
    " SELECT \"case\", frame, sb_x, sb_y, n_payloads, source AS name, bits AS size, residual_bits AS symbols FROM p WHERE r = 1"
)
def trace_smallest_payloads(spark, sf_dir):
    sb = superblocks(spark, sf_dir)
    return L.smallest_payload(sb.select("case", "frame", "sb_x", "sb_y", F.col("source").alias("name"), F.col("bits").alias("size"), F.col(CATEGORIES[3]).alias("symbols")), ["case", "frame", "sb_x", "sb_y"])
