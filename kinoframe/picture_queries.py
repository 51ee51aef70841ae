"""The registered queries on whole pictures, each with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bits as W
from .operators import copies as M
from .operators import crops as K
from .operators import layout as A
from .operators import palettes as L
from .operators import partition as T
from .operators.blocks import total
from .plans.bridges import blocks, table
from .plans.pictures import COLS, PICTURES_SQL, ROWS, pictures
from .queries import QUERIES, register


def on_pictures(sql: str):
    return register(f", pictures AS ({PICTURES_SQL}) {sql}")


def plain(f):
    """Register a query that SQL cannot say; its tests compare it with brute force."""
    QUERIES[f.__name__] = f
    return f


def _more_colours(k: int) -> str:
    return (
        f", d{k} AS (SELECT block_id, upto, t.cost AS cost, list_append(t.p, t.m) AS p FROM (SELECT g.block_id, g.b AS upto, min({{'cost': d.cost + g.cost, 'a': g.a, 'm': g.m, 'p': d.p}}) AS t"
        f" FROM d{k - 1} d JOIN g ON g.block_id = d.block_id AND g.a = d.upto + 1 GROUP BY ALL))"
    )


@register(
    ", s AS (SELECT block_id, px, list_sort(px) AS s, list_sort(list_distinct(px)) AS v FROM blocks),"
    " u AS (SELECT block_id, s, i - 1 AS i, len(v) AS n, len(list_filter(s, lambda x: x < v[i])) AS low, len(list_filter(s, lambda x: x <= v[i])) AS high FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM s WHERE len(v) > 6)),"
    " g AS (SELECT block_id, a, b, m, list_sum(list_transform(s[low + 1 : high], lambda x: abs(x - m)))::BIGINT AS cost FROM (SELECT x.block_id, x.i AS a, y.i AS b, x.s, x.low, y.high, x.s[x.low + (y.high - x.low + 1) // 2] AS m FROM u x JOIN u y ON y.block_id = x.block_id AND y.i >= x.i)),"
    " d1 AS (SELECT block_id, b AS upto, cost, [m] AS p FROM g WHERE a = 0)"
    + "".join(map(_more_colours, range(2, 7)))
    + ", found AS (SELECT block_id, list_sort(p) AS p FROM d6 JOIN (SELECT block_id, max(i) AS upto FROM u GROUP BY 1) USING (block_id, upto) UNION ALL SELECT block_id, CASE WHEN len(v) = 1 THEN list_sort([v[1], CASE WHEN v[1] = 0 THEN 1 ELSE 0 END]) ELSE v END FROM s WHERE len(v) <= 6),"
    " k AS (SELECT block_id, p, list_transform(px, lambda x: list_min(list_transform(range(len(p)), lambda j: {'d': abs(x - p[j + 1]), 'j': j}))) AS k FROM found JOIN s USING (block_id))"
    " SELECT block_id, array_to_string(p, ',') AS palette, list_sum(list_transform(k, lambda t: t.d))::BIGINT AS cost, list_sum(list_transform(range(64), lambda i: (i + 1) * k[i + 1].j))::BIGINT AS weighted FROM k"
)
def block_median_palettes(spark, sf_dir):
    d = L.median_palettes(blocks(spark, sf_dir))
    return d.select("block_id", F.array_join("palette", ",").alias("palette"), "cost", total(F.transform("indices", lambda v, i: (v * (i + 1)).cast("long"))).alias("weighted"))


@on_pictures(
    "SELECT frame, sb_row, sb_col, array_to_string(list_transform(list_sort(list_transform(list_distinct(px), lambda v: {'n': -len(list_filter(px, lambda x: x = v)), 'at': list_position(px, v), 'v': v})), lambda t: t.v)[1:8], ',') AS colours, len(list_distinct(px)) AS n_colours"
    " FROM (SELECT frame, row // 2 AS sb_row, col // 2 AS sb_col, flatten(list(px ORDER BY row, col)) AS px FROM pictures GROUP BY ALL)"
)
def picture_frequent_colours(spark, sf_dir):
    """The eight most frequent colours of each region of 2 by 2 blocks, first seen first of equals."""
    d = pictures(spark, sf_dir).groupBy("frame", F.floor(F.col("row") / 2).alias("sb_row"), F.floor(F.col("col") / 2).alias("sb_col")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "px"))), lambda t: t["px"])).alias("px"))
    d = d.withColumn("id", F.struct("frame", "sb_row", "sb_col"))
    return L.frequency_order(d, "id").select("id.*", F.array_join(F.slice("colours", 1, 8), ",").alias("colours"), F.size("colours").cast("long").alias("n_colours"))


@plain
def picture_region_palettes(spark, sf_dir):
    """Palettes of regions of 2 by 2 blocks, of up to 256 samples; the cost is that of the best cut."""
    d = pictures(spark, sf_dir).groupBy("frame", (F.col("frame") * 1000 + F.floor(F.col("row") / 2) * 50 + F.floor(F.col("col") / 2)).alias("region"))  # dealt by frame already
    d = d.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "px"))), lambda t: t["px"])).alias("px"))
    return L.median_palettes(d, "region").select("region", F.array_join("palette", ",").alias("palette"), "cost")


def _cut_sql() -> str:
    rows, cols = "(y + h // 2 < ph)", "(x + w // 2 < pw)"
    horz, vert = "NOT ((w = 32 AND h = 8) OR (w = 64 AND h = 16))", "NOT ((w = 8 AND h = 32) OR (w = 16 AND h = 64))"
    edge = f"CASE WHEN w = h THEN CASE WHEN {rows} THEN 'v' ELSE 'h' END WHEN h > w THEN CASE WHEN NOT {rows} THEN 'h' WHEN w >= 16 AND NOT (x + w // 4 < pw) THEN 'h' END ELSE CASE WHEN NOT {cols} THEN 'v' WHEN h >= 16 AND NOT (y + h // 4 < ph) THEN 'v' END END"
    small = "(w > 8 OR h > 8) AND len(list_filter(m, lambda k: k // 8 >= y % 64 // 8 AND k // 8 < y % 64 // 8 + h // 8 AND k % 8 >= x % 64 // 8 AND k % 8 < x % 64 // 8 + w // 8)) > 0"
    base = f"CASE WHEN {small} THEN 8 ELSE 16 END"
    along = f"WHEN w > {base} AND {vert} THEN 'v'"
    across = f"WHEN h > {base} AND {horz} THEN 'h'"
    return f"""CASE WHEN (w = 8 AND h = 64) OR (w = 64 AND h = 8) THEN 'n'
        WHEN NOT ({rows} AND {cols}) AND ({edge}) = 'h' AND {horz} THEN 'h' WHEN NOT ({rows} AND {cols}) AND ({edge}) = 'v' AND {vert} THEN 'v'
        WHEN NOT ({rows} AND {cols}) AND {horz} AND NOT ({vert}) THEN 'h' WHEN NOT ({rows} AND {cols}) AND {vert} AND NOT ({horz}) THEN 'v'
        WHEN {rows} AND {cols} AND ((w <= {base} AND h <= {base}) OR (NOT ({small}) AND ((w <= 16 AND h <= 16) OR simple))) THEN 'n'
        WHEN w > h THEN CASE {along} {across} WHEN {rows} AND {cols} THEN 'n' ELSE 'h' END ELSE CASE {across} {along} WHEN {rows} AND {cols} THEN 'n' ELSE 'h' END END"""


#: Pictures whose right and lower sides do not end with a superblock.
_SIZES = f"sizes AS (SELECT DISTINCT frame, 8 * ({COLS} - frame % 3) AS pw, 8 * ({ROWS} - frame % 4) AS ph FROM pictures), vis AS (SELECT p.*, pw, ph FROM pictures p JOIN sizes USING (frame) WHERE 8 * col < pw AND 8 * row < ph)"


@on_pictures(
    f", {_SIZES}, taps AS (SELECT frame, row // 8 AS sb_row, col // 8 AS sb_col, row * 2 + y // 4 AS y, col * 2 + x // 4 AS x, px[8 * y + x + 1] AS v FROM vis, (SELECT unnest([0, 4]) AS y), (SELECT unnest([0, 4]) AS x)),"
    " near AS (SELECT t.*, abs(t.v - l.v) AS dl, abs(t.v - a.v) AS da FROM taps t LEFT JOIN taps l ON l.frame = t.frame AND l.sb_row = t.sb_row AND l.sb_col = t.sb_col AND l.y = t.y AND l.x = t.x - 1 LEFT JOIN taps a ON a.frame = t.frame AND a.sb_row = t.sb_row AND a.sb_col = t.sb_col AND a.x = t.x AND a.y = t.y - 1),"
    " flat AS (SELECT frame, sb_row, sb_col, count(DISTINCT v) <= 8 OR max(v) - min(v) <= 8 OR (count(DISTINCT v) <= 16 AND CASE WHEN count(dl) + count(da) = 0 THEN 0 ELSE (coalesce(sum(dl), 0) + coalesce(sum(da), 0))::BIGINT * 256 // (count(dl) + count(da)) END <= 192) AS simple FROM near GROUP BY ALL),"
    " few AS (SELECT frame, row // 8 AS sb_row, col // 8 AS sb_col, any_value(pw) AS pw, any_value(ph) AS ph, coalesce(list(8 * (row % 8) + col % 8) FILTER (len(list_distinct(px)) BETWEEN 2 AND 4), []) AS m FROM vis GROUP BY ALL),"
    " roots AS (SELECT frame, pw, ph, simple, m, sb_col * 64 AS x, sb_row * 64 AS y, 64::BIGINT AS w, 64::BIGINT AS h FROM few JOIN flat USING (frame, sb_row, sb_col)),"
    f" tree AS (SELECT *, {_cut_sql()} AS cut FROM roots UNION ALL SELECT *, {_cut_sql()} AS cut FROM (SELECT frame, pw, ph, simple, m, CASE WHEN cut = 'v' THEN x + k * (w // 2) ELSE x END AS x, CASE WHEN cut = 'h' THEN y + k * (h // 2) ELSE y END AS y, CASE WHEN cut = 'v' THEN w // 2 ELSE w END AS w, CASE WHEN cut = 'h' THEN h // 2 ELSE h END AS h FROM tree, (SELECT unnest([0, 1]) AS k) WHERE cut <> 'n') WHERE x < pw AND y < ph)"
    " SELECT frame, x, y, w AS width, h AS height FROM tree WHERE cut = 'n'"
)
def picture_partition_tree(spark, sf_dir):
    """The leaves of pictures of 24, 23 or 22 by 16 to 13 blocks."""
    p = pictures(spark, sf_dir)
    sizes = p.select("frame", (8 * (COLS - F.col("frame") % 3)).alias("width"), (8 * (ROWS - F.col("frame") % 4)).alias("height"))
    seen = p.where((F.col("col") < COLS - F.col("frame") % 3) & (F.col("row") < ROWS - F.col("frame") % 4))
    return T.partition_tree(T.features(seen), sizes.distinct())


_STEPS = ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate([(0, 0), *((s * r, s * c) for s in M.NEAR for r, c in M.DIRECTIONS)]))


@on_pictures(
    f", steps AS (SELECT * FROM (VALUES {_STEPS}) t(k, r, c)), near AS (SELECT n.frame, n.row, n.col, min({{'k': k, 'r': r, 'c': c}}) AS t FROM pictures n, steps JOIN pictures b ON b.frame + 1 = n.frame AND b.row = n.row + r AND b.col = n.col + c AND b.px = n.px GROUP BY ALL),"
    " rest AS (SELECT n.frame, n.row, n.col, min({'d': abs(b.row - n.row) + abs(b.col - n.col), 'r': b.row - n.row, 'c': b.col - n.col}) AS t FROM (SELECT * FROM pictures ANTI JOIN near USING (frame, row, col)) n JOIN pictures b ON b.frame + 1 = n.frame AND b.px = n.px GROUP BY ALL)"
    " SELECT frame, row, col, CASE WHEN t.k = 0 THEN 'in place' ELSE 'near' END AS source, t.r::BIGINT AS mv_row, t.c::BIGINT AS mv_col FROM near UNION ALL SELECT frame, row, col, 'anywhere', t.r::BIGINT, t.c::BIGINT FROM rest"
)
def picture_motion_cascade(spark, sf_dir):
    return M.motion_cascade(pictures(spark, sf_dir))


@plain
def picture_motion_vectors(spark, sf_dir):
    """Each block's vector by the whole list of candidates, neighbours' vectors among them."""
    return M.frame_vectors(pictures(spark, sf_dir))


@plain
def picture_motion_totals(spark, sf_dir):
    return M.motion_totals(M.frame_vectors(pictures(spark, sf_dir)))


_CASCADE = (
    f", steps AS (SELECT * FROM (VALUES {_STEPS}) t(k, r, c)), near AS (SELECT n.frame, n.row, n.col, min({{'k': k, 'r': r, 'c': c}}) AS t FROM pictures n, steps JOIN pictures b ON b.frame + 1 = n.frame AND b.row = n.row + r AND b.col = n.col + c AND b.px = n.px GROUP BY ALL),"
    " rest AS (SELECT n.frame, n.row, n.col, min({'d': abs(b.row - n.row) + abs(b.col - n.col), 'r': b.row - n.row, 'c': b.col - n.col}) AS t FROM (SELECT * FROM pictures ANTI JOIN near USING (frame, row, col)) n JOIN pictures b ON b.frame + 1 = n.frame AND b.px = n.px GROUP BY ALL),"
    " mv AS (SELECT frame, row, col, t.r::BIGINT AS r, t.c::BIGINT AS c FROM near UNION ALL SELECT frame, row, col, t.r::BIGINT, t.c::BIGINT FROM rest)"
)


@on_pictures(
    _CASCADE + ", k AS (SELECT frame, p.row // 8 AS tile_row, p.col // 8 AS tile_col, count(*) AS n_blocks, count(r) AS n_copied, count(*) FILTER (r = 0 AND c = 0) AS still, count(DISTINCT CASE WHEN r IS NOT NULL THEN (r, c) END) AS n_motions FROM pictures p LEFT JOIN mv USING (frame, row, col) GROUP BY ALL)"
    " SELECT * EXCLUDE still, CASE WHEN still = n_blocks THEN 'unchanged' WHEN n_copied = n_blocks AND n_motions = 1 THEN 'motion' WHEN n_copied = n_blocks THEN 'mixed' WHEN n_copied > 0 THEN 'partial' ELSE 'intra' END AS mode, CASE WHEN still = n_blocks THEN 'unchanged' WHEN n_copied > still THEN 'moved' ELSE 'residual' END AS lossy FROM k"
)
def picture_tile_modes(spark, sf_dir):
    p = pictures(spark, sf_dir)
    return M.tile_modes(p, M.motion_cascade(p))


@on_pictures(
    _CASCADE + ", m AS (SELECT frame, row // 2 AS leaf_row, col // 2 AS leaf_col, count(*) AS n, count(r) AS k, count(DISTINCT CASE WHEN r IS NOT NULL THEN (r, c) END) AS d, any_value(r || ',' || c) AS mode FROM pictures LEFT JOIN mv USING (frame, row, col) GROUP BY ALL) SELECT frame, leaf_row, leaf_col, CASE WHEN n = 4 AND k = 4 AND d = 1 THEN mode END AS mode FROM m"
)
def picture_merged_skips(spark, sf_dir):
    """Leaves of 2 by 2 blocks that are copied whole by one vector; blocks without a copy merge with nothing."""
    p = pictures(spark, sf_dir)
    mode = F.concat_ws(",", F.col("mv_row").cast("string"), F.col("mv_col").cast("string"))
    found = M.motion_cascade(p).select("frame", "row", "col", mode.alias("mode"))
    return A.merged_leaves(p.select("frame", "row", "col").join(found, ["frame", "row", "col"], "left"), 2)


#: Pictures with every fifth one shown twice more.
_STILLS = "stills AS (SELECT 3 * frame + k AS frame, row, col, px FROM pictures, (SELECT unnest([0, 1, 2]) AS k) WHERE frame % 5 = 0 UNION ALL SELECT 3 * frame + 2, row, col, px FROM pictures WHERE frame % 5 <> 0)"


@on_pictures(
    f", {_STILLS}, n AS (SELECT frame, count(*) AS n, list(px ORDER BY row, col) AS l FROM stills GROUP BY 1), k AS (SELECT a.frame, CASE WHEN b.frame IS NULL THEN 'key' WHEN a.n = b.n AND a.l = b.l THEN 'existing' ELSE 'inter' END AS kind FROM n a LEFT JOIN n b ON b.frame + 1 = a.frame)"
    " SELECT frame, kind, max(CASE WHEN kind <> 'existing' THEN frame END) OVER (ORDER BY frame) AS shown FROM k"
)
def picture_kinds(spark, sf_dir):
    """Pictures of a film in which every fifth one stays for three: key, inter or existing, and which one is shown."""
    p = pictures(spark, sf_dir)
    times = F.when(F.col("frame") % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    return M.picture_kinds(p.withColumn("k", F.explode(times)).select((F.col("frame") * 3 + F.col("k")).alias("frame"), "row", "col", "px"))


_Z = "(" + " + ".join(f"((col::BIGINT >> {k}) & 1) * {4**k} + ((row::BIGINT >> {k}) & 1) * {2 * 4**k}" for k in range(3)) + " + col // 8 * 64)"


@on_pictures(
    f", z AS (SELECT *, row // 8 AS sb_row, {_Z} AS z FROM pictures), best AS (SELECT b.frame, b.row, b.col, max({{'z': a.z, 'row': a.row, 'col': a.col}}) AS t FROM z b JOIN z a ON a.frame = b.frame AND a.sb_row = b.sb_row AND a.px = b.px AND a.z < b.z AND b.col // 8 - a.col // 8 <= 4 AND (a.row < b.row OR a.col < b.col) GROUP BY ALL)"
    " SELECT frame, row, col, t.row AS ref_row, t.col AS ref_col, CASE WHEN row = t.row AND col = t.col + 1 THEN 'left' WHEN row = t.row + 1 AND col = t.col THEN 'above' ELSE 'other' END AS kind FROM best"
)
def picture_copies(spark, sf_dir):
    return M.picture_copies(pictures(spark, sf_dir))


@register(
    ", e AS (SELECT event_type AS stream, event_id AS place, user_id % 37 AS v FROM events), seen AS (SELECT a.stream, a.place, b.v, max(b.place) AS latest FROM e a JOIN e b ON b.stream = a.stream AND b.place <= a.place GROUP BY ALL)"
    " SELECT stream, place, string_agg(v::VARCHAR, ',' ORDER BY latest) AS history FROM (SELECT *, row_number() OVER (PARTITION BY stream, place ORDER BY latest DESC) AS k FROM seen) WHERE k <= 5 GROUP BY ALL"
)
def stream_last_distinct(spark, sf_dir):
    """The last five distinct users (37 classes of them) of each event type, after each event."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("place"), (F.col("user_id") % 37).alias("value"))
    return M.last_distinct(e, span=512)


_DRAW = "(('0x' || substr(md5('{seed}:' || crop || ':{what}'), 1, 8))::BIGINT)"


@on_pictures(
    ", whole AS (SELECT frame, count(*) AS n FROM pictures GROUP BY 1 HAVING count(*) = 384), src AS (SELECT 'even' AS source, list(frame ORDER BY frame) FILTER (frame % 2 = 0) AS f FROM whole UNION ALL SELECT 'odd', list(frame ORDER BY frame) FILTER (frame % 2 = 1) FROM whole),"
    " sizes AS (SELECT source, f, w, h, source || '_' || w || 'x' || h AS crop FROM src, (SELECT unnest(range(8, 65, 8)) AS w), (SELECT unnest(range(8, 65, 8)) AS h) WHERE len(f) > 0),"
    f" drawn AS (SELECT crop, w, h, f[{_DRAW.format(seed=7, what='frame')} % len(f) + 1] AS frame, {_DRAW.format(seed=7, what='x')} % (192 - w + 1) AS x0, {_DRAW.format(seed=7, what='y')} % ((128 - h) // 2 + 1) * 2 AS y0 FROM sizes),"
    " s AS (SELECT d.crop, d.frame, y // 8 AS row, x // 8 AS col, y % 8 * 8 + x % 8 AS i, (y0 + y) // 8 AS r, (x0 + x) // 8 AS c, (y0 + y) % 8 * 8 + (x0 + x) % 8 AS j FROM (SELECT *, unnest(range(h)) AS y FROM drawn) d JOIN (SELECT crop, unnest(range(w)) AS x FROM drawn) e ON e.crop = d.crop)"
    " SELECT crop, s.row, s.col, sum(px[j + 1])::BIGINT AS total, sum((i + 1) * px[j + 1])::BIGINT AS weighted FROM s JOIN pictures p ON p.frame = s.frame AND p.row = r AND p.col = c GROUP BY ALL"
)
def picture_crop_sweep(spark, sf_dir):
    """Crops of all sizes from 8x8 to 64x64 out of the even and the odd pictures that are whole, as blocks."""
    p = pictures(spark, sf_dir)
    whole = p.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") == ROWS * COLS).select("frame", (F.col("frame") % 2).alias("half"))
    src = whole.groupBy("half").agg(F.sort_array(F.collect_list("frame")).alias("f"))
    sources = src.select(F.when(F.col("half") == 0, "even").otherwise("odd").alias("source"), F.size("f").cast("long").alias("frames"), F.lit(8 * COLS).cast("long").alias("width"), F.lit(8 * ROWS).cast("long").alias("height"), "f")
    crops = K.crop_sweep(sources, 7, align_y=2).join(sources.select("source", "f"), "source")
    crops = crops.withColumn("frame", F.get("f", F.col("frame").cast("int"))).drop("f")
    sizes = whole.select("frame", F.lit(8 * COLS).alias("width"), F.lit(8 * ROWS).alias("height"))
    d = K.crop_blocks(p, crops, sizes)
    return d.select("crop", "row", "col", total("px").alias("total"), total(F.transform("px", lambda v, i: v * (i + 1))).alias("weighted"))


@on_pictures(
    ", p AS (SELECT * FROM (VALUES (0, 0, -1, 'left'), (1, -1, 0, 'above'), (2, -1, -1, 'above left')) t(k, r, c, kind)), m AS (SELECT n.frame, n.row, n.col, min({'k': p.k, 'r': p.r, 'c': p.c, 'kind': p.kind}) AS t FROM pictures n, p JOIN pictures b ON b.frame = n.frame AND b.row = n.row + p.r AND b.col = n.col + p.c AND b.px = n.px WHERE n.row % 8 + p.r >= 0 AND n.col % 8 + p.c >= 0 GROUP BY ALL)"
    " SELECT frame, row, col, t.kind AS kind, (t.r * 8)::BIGINT AS bv_row, (t.c * 8)::BIGINT AS bv_col FROM m"
)
def picture_local_matches(spark, sf_dir):
    return M.local_matches(pictures(spark, sf_dir))


@plain
def picture_leaf_classes(spark, sf_dir):
    """Leaves of the partition trees by size; its parts have SQL or tests."""
    p = pictures(spark, sf_dir)
    sizes = p.select("frame", F.lit(8 * COLS).alias("width"), F.lit(8 * ROWS).alias("height")).distinct()
    return W.leaf_classes(T.partition_tree(T.features(p), sizes))
