"""The registered queries on transforms and prediction by array kernels, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import kernels as A
from .operators import quantize as Q
from .operators.blocks import total
from .picture_queries import on_pictures, plain
from .plans.bridges import blocks, table
from .plans.pictures import PLANES_SQL, pictures, planes
from .queries import register


def _product(rows: tuple[tuple[int, ...], ...], left: str, then: str) -> str:
    """DuckDB list of 16: the matrix times the 4x4 list `left` (raster order, from 1), each sum s put through `then`."""
    m = "[" + ", ".join(str(v) for r in rows for v in r) + "]"
    total_ = f"list_sum(list_transform(range(4), lambda k: {m}[4 * (i // 4) + k + 1] * {left}[4 * k + i % 4 + 1]))"
    return f"list_transform(range(16), lambda i: {then.format(s=total_)})"


def _turned(values: str) -> str:
    return f"list_transform(range(16), lambda i: {values}[4 * (i % 4) + i // 4 + 1])"


_INVERSE_T = tuple(zip(*A.INVERSE, strict=True))


@register(
    ", q AS (SELECT block_id, q, list_transform(range(16), lambda i: px[8 * (4 * (q // 2) + i // 4) + 4 * (q % 2) + i % 4 + 1]::BIGINT - 128) AS x FROM blocks, (SELECT unnest(range(4)) AS q)),"
    " a AS (SELECT *, list_transform(x, lambda v, i: 16 * v + CASE WHEN i = 1 AND v <> 0 THEN 1 ELSE 0 END) AS t FROM q),"
    f" b AS (SELECT block_id, q, x, {_product(A.FORWARD, 't', '(({s})::BIGINT + 8192) >> 14')} AS t FROM a), b2 AS (SELECT block_id, q, x, {_turned('t')} AS t FROM b),"
    f" c AS (SELECT block_id, q, x, {_product(A.FORWARD, 't', '(((({s})::BIGINT + 8192) >> 14) + 1) >> 2')} AS t FROM b2), c2 AS (SELECT block_id, q, x, {_turned('t')} AS c, t FROM c),"
    f" d AS (SELECT block_id, q, x, c, {_product(_INVERSE_T, 'list_transform(t, lambda v: greatest(least(v, 32767), -32768))', 'greatest(least((({s})::BIGINT + 64) >> 7, 32767), -32768)')} AS t FROM c2), d2 AS (SELECT block_id, q, x, c, {_turned('t')} AS t FROM d),"
    f" e AS (SELECT block_id, q, x, c, {_product(_INVERSE_T, 't', 'greatest(least((({s})::BIGINT + 512) >> 10, 255), -256)')} AS y FROM d2)"
    " SELECT block_id, q AS quarter, c[1] AS dc, list_sum(list_transform(c[2:], lambda v: abs(v)))::BIGINT AS ac, list_sum(list_transform(c, lambda v, i: v * i))::BIGINT AS weighted, list_max(list_transform(range(16), lambda i: abs(y[i + 1] - x[i + 1]))) AS error FROM e"
)
def block_dct_pair(spark, sf_dir):
    """DC, sum of |AC|, a sum weighted by place, and the largest error after the inverse, of each 4x4 quarter."""
    c = F.col("coefficients")
    d = A.dct_quarters(blocks(spark, sf_dir))
    return d.select("block_id", "quarter", c[0].alias("dc"), (total(F.transform(c, F.abs)) - F.abs(c[0])).alias("ac"), total(F.transform(c, lambda v, i: v * (i + 1))).alias("weighted"), "error")


_SLOPE = "[" + ", ".join(map(str, A.SLOPES)) + "]"
_ALONG = "CASE WHEN ({d} * ({b} + 1) >> 6) + {a} >= 7 THEN {e}[8] ELSE ({e}[({d} * ({b} + 1) >> 6) + {a} + 1] * (32 - ((({d} * ({b} + 1)) & 63) >> 1)) + {e}[({d} * ({b} + 1) >> 6) + {a} + 2] * ((({d} * ({b} + 1)) & 63) >> 1) + 16) >> 5 END"
_FLOOR = "floor({p} / 64)::BIGINT"
_MIX = "({e}[" + _FLOOR + " + 2] * (32 - (({p} - " + _FLOOR + " * 64) >> 1)) + {e}[" + _FLOOR + " + 3] * (({p} - " + _FLOOR + " * 64) >> 1) + 16) >> 5"


@on_pictures(
    ", a AS (SELECT frame, row * 2 + y // 4 AS y, col * 2 + x // 4 AS x, list_transform(range(16), lambda i: px[8 * (y + i // 4) + x + i % 4 + 1]) AS px FROM pictures, (SELECT unnest([0, 4]) AS y), (SELECT unnest([0, 4]) AS x)),"
    " e AS (SELECT a.frame, a.y, a.x, a.px, CASE WHEN u.px IS NULL THEN list_transform(range(8), lambda i: 127) ELSE u.px[13:16] || CASE WHEN v.px IS NULL THEN list_transform(range(4), lambda i: u.px[16]) ELSE v.px[13:16] END END AS above,"
    " CASE WHEN l.px IS NULL THEN list_transform(range(8), lambda i: 129) ELSE [l.px[4], l.px[8], l.px[12], l.px[16]] || CASE WHEN m.px IS NULL THEN list_transform(range(4), lambda i: l.px[16]) ELSE [m.px[4], m.px[8], m.px[12], m.px[16]] END END AS side,"
    " CASE WHEN u.px IS NULL THEN coalesce(l.px[4], 128) WHEN l.px IS NULL THEN u.px[13] ELSE k.px[16] END AS corner FROM a LEFT JOIN a u ON u.frame = a.frame AND u.y = a.y - 1 AND u.x = a.x LEFT JOIN a v ON v.frame = a.frame AND v.y = a.y - 1 AND v.x = a.x + 1"
    " LEFT JOIN a l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN a m ON m.frame = a.frame AND m.y = a.y + 1 AND m.x = a.x - 1 LEFT JOIN a k ON k.frame = a.frame AND k.y = a.y - 1 AND k.x = a.x - 1),"
    f" s AS (SELECT frame, y, x, g, CASE WHEN g < 90 THEN {_SLOPE}[g + 1] ELSE {_SLOPE}[180 - g + 1] END AS dx, CASE WHEN g > 180 THEN {_SLOPE}[270 - g + 1] ELSE {_SLOPE}[greatest(g - 90, 0) + 1] END AS dy, px[i + 1] AS v, i // 4 AS r, i % 4 AS c, above, side, [corner] || above AS top, [corner] || side AS edge"
    f" FROM (SELECT *, unnest(range(16)) AS i FROM e), (SELECT unnest({list(A.ANGLES)}) AS g)),"
    " p AS (SELECT *, c * 64 - (r + 1) * dx AS fx, r * 64 - (c + 1) * dy AS fy FROM s),"
    f" q AS (SELECT frame, y, x, g, sum(abs(v - CASE WHEN g < 90 THEN {_ALONG.format(d='dx', a='c', b='r', e='above')} WHEN g > 180 THEN {_ALONG.format(d='dy', a='r', b='c', e='side')} WHEN fx >= -64 THEN {_MIX.format(e='top', p='fx')} ELSE {_MIX.format(e='edge', p='fy')} END))::BIGINT AS sad FROM p GROUP BY ALL)"
    " SELECT frame, y, x, min({'s': sad, 'g': g}).g::BIGINT AS angle, min(sad) AS sad, sum(sad * g)::BIGINT AS weighted FROM q GROUP BY ALL"
)
def picture_directions(spark, sf_dir):
    """The best of six directions for each 4x4 area of pictures, from the edges of its neighbours."""
    d = A.best_directions(A.areas(pictures(spark, sf_dir)))
    weighted = F.aggregate(F.zip_with("sads", F.array(*(F.lit(a).cast("long") for a in A.ANGLES)), lambda s, a: s * a), F.lit(0).cast("long"), lambda t, v: t + v)
    return d.select("frame", "y", "x", "angle", "sad", weighted.alias("weighted"))


_MODES = ("dc", "v", "h", "paeth", "smooth", "smooth_v", "smooth_h")
_PULL = f"{list(A.PULLS)}"


@on_pictures(
    ", a AS (SELECT frame, row * 2 + y // 4 AS y, col * 2 + x // 4 AS x, list_transform(range(16), lambda i: px[8 * (y + i // 4) + x + i % 4 + 1]::BIGINT) AS px FROM pictures, (SELECT unnest([0, 4]) AS y), (SELECT unnest([0, 4]) AS x)),"
    " e AS (SELECT a.frame, a.y, a.x, a.px, u.px IS NOT NULL AS ha, l.px IS NOT NULL AS hl, CASE WHEN u.px IS NULL THEN [127, 127, 127, 127, 127] ELSE u.px[13:16] || [coalesce(v.px[13], u.px[16])] END AS t, CASE WHEN l.px IS NULL THEN [129, 129, 129, 129, 129] ELSE [l.px[4], l.px[8], l.px[12], l.px[16], coalesce(m.px[4], l.px[16])] END AS s,"
    " CASE WHEN u.px IS NULL THEN coalesce(l.px[4], 128) WHEN l.px IS NULL THEN u.px[13] ELSE k.px[16] END AS k FROM a LEFT JOIN a u ON u.frame = a.frame AND u.y = a.y - 1 AND u.x = a.x LEFT JOIN a v ON v.frame = a.frame AND v.y = a.y - 1 AND v.x = a.x + 1 LEFT JOIN a l ON l.frame = a.frame AND l.y = a.y AND l.x = a.x - 1"
    " LEFT JOIN a m ON m.frame = a.frame AND m.y = a.y + 1 AND m.x = a.x - 1 LEFT JOIN a k ON k.frame = a.frame AND k.y = a.y - 1 AND k.x = a.x - 1),"
    " i AS (SELECT frame, y, x, px[i + 1] AS p, t[i % 4 + 1] AS v, s[i // 4 + 1] AS h, k, CASE WHEN ha AND hl THEN (list_sum(t[1:4]) + list_sum(s[1:4]) + 4) // 8 WHEN ha THEN (list_sum(t[1:4]) + 2) // 4 WHEN hl THEN (list_sum(s[1:4]) + 2) // 4 ELSE 128 END AS dc, t[5] AS tr, s[5] AS bl, i // 4 AS r, i % 4 AS c FROM (SELECT *, unnest(range(16)) AS i FROM e)),"
    " d AS (SELECT *, bl + floor(((v - bl) * (3 - r) + 2) / 4)::BIGINT AS dn, tr + floor(((h - tr) * (3 - c) + 2) / 4)::BIGINT AS ac FROM i),"
    f" f AS (SELECT *, dn + floor(((v - dn) * {_PULL}[r + 1] + 32) / 64)::BIGINT AS sv, ac + floor(((h - ac) * {_PULL}[c + 1] + 32) / 64)::BIGINT AS sh FROM d),"
    " g AS (SELECT frame, y, x, p, unnest([dc, v, h, CASE WHEN abs(v - k) <= abs(h - k) AND abs(v - k) <= abs(v + h - 2 * k) THEN h WHEN abs(h - k) <= abs(v + h - 2 * k) THEN v ELSE k END, greatest(least(floor((sv + sh + 1) / 2)::BIGINT, 255), 0), greatest(least(sv, 255), 0), greatest(least(sh, 255), 0)]) AS q, unnest(range(7)) AS j FROM f),"
    f" w AS (SELECT frame, y, x, j, sum(abs(p - q))::BIGINT AS sad FROM g GROUP BY ALL) SELECT frame, y, x, {list(_MODES)}[min({{'s': sad, 'j': j}}).j + 1] AS mode, min(sad) AS sad, sum(sad * (j + 1))::BIGINT AS weighted FROM w GROUP BY ALL"
)
def picture_area_modes(spark, sf_dir):
    """The best of seven plain predictions for each 4x4 area of pictures, at their edges too."""
    d = A.best_plain_modes(A.areas(pictures(spark, sf_dir)))
    return d.select("frame", "y", "x", "mode", "sad", total(F.transform("sads", lambda s, i: s * (i + 1))).alias("weighted"))


_LOG2 = "(length(bin({v})) - 1)"


@on_pictures(
    f", planes AS ({PLANES_SQL}), n AS (SELECT p.*, u.px AS u, u.cb AS uc, l.px AS l, l.cb AS lc FROM planes p LEFT JOIN planes u ON u.frame = p.frame AND u.row = p.row - 1 AND u.col = p.col LEFT JOIN planes l ON l.frame = p.frame AND l.row = p.row AND l.col = p.col - 1),"
    " k AS (SELECT *, CASE WHEN u IS NOT NULL AND l IS NOT NULL THEN [u[59], u[63], l[24], l[56]] WHEN u IS NOT NULL THEN [u[58], u[60], u[62], u[64]] ELSE [l[16], l[32], l[48], l[64]] END AS x, CASE WHEN u IS NOT NULL AND l IS NOT NULL THEN [uc[59], uc[63], lc[24], lc[56]] WHEN u IS NOT NULL THEN [uc[58], uc[60], uc[62], uc[64]] ELSE [lc[16], lc[32], lc[48], lc[64]] END AS c FROM n),"
    " s1 AS (SELECT *, CASE WHEN x[1] > x[3] THEN [3, 1] ELSE [1, 3] END AS lo, CASE WHEN x[2] > x[4] THEN [4, 2] ELSE [2, 4] END AS hi FROM k),"
    " s2 AS (SELECT * EXCLUDE (lo, hi), CASE WHEN x[lo[1]] > x[hi[2]] THEN hi ELSE lo END AS lo, CASE WHEN x[lo[1]] > x[hi[2]] THEN lo ELSE hi END AS hi FROM s1),"
    " s3 AS (SELECT * EXCLUDE (lo, hi), CASE WHEN x[lo[2]] > x[hi[1]] THEN [lo[1], hi[1]] ELSE lo END AS lo, CASE WHEN x[lo[2]] > x[hi[1]] THEN [lo[2], hi[2]] ELSE hi END AS hi FROM s2),"
    " m AS (SELECT *, (x[lo[1]] + x[lo[2]] + 1) // 2 AS x0, (c[lo[1]] + c[lo[2]] + 1) // 2 AS y0, (x[hi[1]] + x[hi[2]] + 1) // 2 - (x[lo[1]] + x[lo[2]] + 1) // 2 AS dx, (c[hi[1]] + c[hi[2]] + 1) // 2 - (c[lo[1]] + c[lo[2]] + 1) // 2 AS dy FROM s3),"
    f" t AS (SELECT *, {_LOG2.format(v='greatest(dx, 1)')} AS lx, ((greatest(dx, 1) * 16) >> {_LOG2.format(v='greatest(dx, 1)')}::INTEGER) & 15 AS part, CASE WHEN dy = 0 THEN 0 ELSE length(bin(abs(dy))) END::INTEGER AS yb FROM m),"
    f" w AS (SELECT *, floor((dy * ({list(A.RECIPROCALS)}[part + 1] | 8) + ((1 << yb) >> 1)) / (1 << yb))::BIGINT AS a0, 3 + lx + CASE WHEN part <> 0 THEN 1 ELSE 0 END - yb AS sh0 FROM t),"
    " z AS (SELECT frame, row, col, px, cb, CASE WHEN u IS NULL AND l IS NULL THEN 0 WHEN dx <= 0 THEN 0 WHEN sh0 < 1 THEN 15 * sign(a0) ELSE a0 END::BIGINT AS a, CASE WHEN (u IS NULL AND l IS NULL) OR dx <= 0 THEN 0 ELSE greatest(sh0, 1) END::INTEGER AS shift, u IS NULL AND l IS NULL AS none, x0, y0 FROM w),"
    " y AS (SELECT *, CASE WHEN none THEN 128 ELSE y0 - floor(a * x0 / (1 << shift))::BIGINT END AS b FROM z)"
    " SELECT frame, row, col, a, b, shift::BIGINT AS shift, list_sum(list_transform(range(64), lambda i: abs(cb[i + 1] - greatest(least(floor(a * px[i + 1] / (1 << shift))::BIGINT + b, 255), 0))))::BIGINT AS sad FROM y"
)
def picture_chroma_models(spark, sf_dir):
    return A.chroma_models(planes(spark, sf_dir))


@register(
    f", n AS (SELECT l_partkey % 300 AS q_index, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT *, greatest(least(q_index, 255), 1) AS i FROM n) SELECT q_index, n, CASE WHEN i < 25 THEN {list(Q.STEPS)}[i + 1] ELSE {list(Q.STEPS)}[(i - 1) % 24 + 2] * (1 << ((i - 1) // 24)) END::BIGINT AS step FROM c"
)
def format_quantizer_steps(spark, sf_dir):
    """The steps of quantizer indices of 8-bit films, with how many items each stands for."""
    d = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 300).alias("q_index")).agg(F.count("*").alias("n"))
    return d.select("q_index", "n", Q.step_column(F.col("q_index")).alias("step"))


@plain
def block_transform_choices(spark, sf_dir):
    """The choice among four sets of levels for each 4x4 quarter at quantizer index 120; its tests compare it with one block at a time."""
    d = Q.transform_choices(blocks(spark, sf_dir), 120)
    return d.select("block_id", "quarter", "choice", "score", "bits", "sse", total(F.transform("levels", lambda v, i: v * (i + 1))).alias("weighted"))


_SKIP_QP = 27
_SKIP = f"CASE WHEN {{v}} = 0 THEN 0 ELSE greatest(least(floor(({{v}} * {Q.SKIP_SCALES[_SKIP_QP % 6]} + {1 << (5 - _SKIP_QP // 6)}) / {1 << (6 - _SKIP_QP // 6)})::BIGINT, 32767), -32768) END"


@register(
    f", r AS (SELECT block_id, i, px[i + 1]::BIGINT - 128 AS r FROM (SELECT *, unnest(range(64)) AS i FROM blocks)), e AS (SELECT *, sign(r)::BIGINT * ((abs(r) * {1 << (6 - _SKIP_QP // 6)} + {Q.SKIP_SCALES[_SKIP_QP % 6] // 2}) // {Q.SKIP_SCALES[_SKIP_QP % 6]}) AS e FROM r),"
    f" c AS (SELECT *, e + k AS v, {_SKIP.format(v='(e + k)')} AS b FROM e, (SELECT unnest([0, -2, -1, 1, 2]) AS k, unnest(range(5)) AS o)),"
    " m AS (SELECT block_id, i, r, min({'e': (r - b) * (r - b), 's': abs(v), 'o': o, 'v': v}) AS m FROM c GROUP BY ALL), l AS (SELECT block_id, i, r, CASE WHEN r = 0 THEN 0 ELSE m.v END AS v FROM m)"
    f" SELECT block_id, sum(v * (i + 1))::BIGINT AS weighted, sum((r - {_SKIP.format(v='v')}) ** 2)::BIGINT AS sse FROM l GROUP BY block_id"
)
def block_transform_skip(spark, sf_dir):
    """Levels without a transform at qp 27."""
    return Q.skip_blocks(blocks(spark, sf_dir), _SKIP_QP).select("block_id", total(F.transform("levels", lambda v, i: v * (i + 1))).alias("weighted"), "sse")
