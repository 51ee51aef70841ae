"""The registered queries on rates, names, precedence and formats, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import metadata as D
from .plans.bridges import table
from .queries import register


def _key():
    return F.col("p_partkey")


_RATE = "CASE p_partkey % 6 WHEN 0 THEN (p_size % 61)::VARCHAR WHEN 1 THEN (p_partkey % 120) || '.97' WHEN 2 THEN (1000 * (p_size % 61)) || '/1001' WHEN 3 THEN (p_partkey % 90) || '/' || (p_size % 4) WHEN 4 THEN '.5' ELSE 'fast' END"


def _rate_text():
    k, size, text = _key() % 6, F.col("p_size"), lambda c: c.cast("string")
    return F.when(k == 0, text(size % 61)).when(k == 1, F.concat(text(_key() % 120), F.lit(".97"))).when(k == 2, F.concat(text(1000 * (size % 61)), F.lit("/1001"))).when(k == 3, F.concat(text(_key() % 90), F.lit("/"), text(size % 4))).when(k == 4, ".5").otherwise("fast")


@register(
    f", t AS (SELECT p_partkey AS id, {_RATE} AS fps FROM part), r AS (SELECT *, CASE WHEN contains(fps, '/') THEN try_cast(split_part(fps, '/', 1) AS BIGINT) WHEN contains(fps, '.') THEN try_cast(replace(fps, '.', '') AS BIGINT) ELSE try_cast(fps AS BIGINT) END AS n, CASE WHEN contains(fps, '/') THEN try_cast(split_part(fps, '/', 2) AS BIGINT) WHEN contains(fps, '.') THEN (10 ** length(split_part(fps, '.', 2)))::BIGINT ELSE 1 END AS d FROM t),"
    " g AS (SELECT id, fps, CASE WHEN n > 0 AND d > 0 THEN n // gcd(n, d) END AS num, CASE WHEN n > 0 AND d > 0 THEN d // gcd(n, d) END AS den FROM r)"
    " SELECT id, fps, num, den, CASE WHEN contains(fps, '/') THEN num * 1001 = 30000 * den WHEN contains(fps, '.') THEN abs(num * 1001 - 30000 * den) * 100 <= den * 1001 ELSE num = 30 END AS ntsc FROM g"
)
def format_rates(spark, sf_dir):
    """Rates as exact fractions, and whether each declares a film of 30000/1001."""
    d = table(spark, sf_dir, "part").select(_key().alias("id"), _rate_text().alias("fps"))
    r = D.rate(F.col("fps"))
    ntsc = F.struct(F.lit(30000).cast("long").alias("num"), F.lit(1001).cast("long").alias("den"))
    return d.select("id", "fps", r["num"].alias("num"), r["den"].alias("den"), D.rates_match(F.col("fps"), ntsc).alias("ntsc"))


_NAME = (
    "'Clip_' || CASE p_partkey % 7 WHEN 0 THEN p_size || 'x' || (p_partkey % 200) || '_' || (p_size * 3) || 'f.yuv' WHEN 1 THEN (p_size * 2) || 'X' || (p_partkey % 200 + 8) || 'p' || (p_partkey % 60) || '_yuv422p10le_' || p_size || 'frames.y4m'"
    " WHEN 2 THEN (p_size + 1) || 'x' || (p_size + 2) || '_2997_' || p_partkey || 'f_gray12.yuv' WHEN 3 THEN '12fps_' || (p_size + 1) || 'x16-' || (p_partkey % 50 + 1) || '.yuv' WHEN 4 THEN (p_size + 1) || 'x8_5994.yuv' WHEN 5 THEN 'still_i210.yuv' ELSE (p_size + 1) || 'x24_rgb24_25_3f.bin' END"
)


def _name():
    k, size, text = _key() % 7, F.col("p_size"), lambda c: c.cast("string")
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else text(p) for p in parts))
    tail = F.when(k == 0, of(size, "x", _key() % 200, "_", size * 3, "f.yuv")).when(k == 1, of(size * 2, "X", _key() % 200 + 8, "p", _key() % 60, "_yuv422p10le_", size, "frames.y4m")).when(k == 2, of(size + 1, "x", size + 2, "_2997_", _key(), "f_gray12.yuv"))
    tail = tail.when(k == 3, of("12fps_", size + 1, "x16-", _key() % 50 + 1, ".yuv")).when(k == 4, of(size + 1, "x8_5994.yuv")).when(k == 5, "still_i210.yuv").otherwise(of(size + 1, "x24_rgb24_25_3f.bin"))
    return F.concat(F.lit("Clip_"), tail)


@register(
    f", n AS (SELECT p_partkey AS id, {_NAME} AS file, p_partkey % 7 AS k, p_size::BIGINT AS s, p_partkey FROM part)"
    " SELECT id, file, CASE k WHEN 0 THEN nullif(s, 0) WHEN 1 THEN nullif(s * 2, 0) WHEN 5 THEN NULL ELSE s + 1 END AS width, CASE k WHEN 0 THEN nullif(p_partkey % 200, 0) WHEN 1 THEN p_partkey % 200 + 8 WHEN 2 THEN s + 2 WHEN 3 THEN 16 WHEN 4 THEN 8 WHEN 6 THEN 24 END AS height,"
    " CASE WHEN k = 0 AND s > 0 AND p_partkey % 200 > 0 THEN 'yuv420p8' WHEN k = 1 AND s > 0 THEN 'yuv422p10le' WHEN k = 2 THEN 'gray12le' WHEN k IN (3, 4) THEN 'yuv420p8' WHEN k = 6 THEN 'rgb24' END AS format,"
    " CASE k WHEN 0 THEN nullif(s * 3, 0) WHEN 1 THEN nullif(s, 0) WHEN 2 THEN p_partkey WHEN 3 THEN 12 WHEN 6 THEN 3 END AS frames,"
    " CASE WHEN k = 1 AND s > 0 AND p_partkey % 60 > 0 THEN (p_partkey % 60)::VARCHAR WHEN k = 2 THEN '29.97' WHEN k = 3 THEN (p_partkey % 50 + 1)::VARCHAR WHEN k = 4 THEN '5994' END AS fps FROM n"
)
def format_inferred(spark, sf_dir):
    """What the names of files say of them, by seven patterns."""
    d = table(spark, sf_dir, "part").select(_key().alias("id"), _name().alias("file"))
    return D.infer_metadata(d)


@register(
    ", o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 640 END AS ow, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'gray8' END AS oform, CASE WHEN o_orderkey % 5 = 0 THEN '25' END AS ofps, CASE WHEN o_orderkey % 4 < 2 THEN 1280 END AS hw, CASE WHEN o_orderkey % 4 < 2 THEN 'yuv444p8' END AS hform, CASE WHEN o_orderkey % 4 = 1 THEN '30/1' END AS hfps, CASE WHEN o_orderkey % 7 > 2 THEN 320 END AS nw, CASE WHEN o_orderkey % 7 > 2 THEN 'yuv420p8' END AS nform, CASE WHEN o_orderkey % 7 > 4 THEN '60' END AS nfps FROM orders)"
    " SELECT id, coalesce(ow, hw, nw)::BIGINT AS width, (coalesce(ow, hw, nw) / 2)::BIGINT AS height, CASE WHEN ow IS NOT NULL THEN coalesce(oform, hform) WHEN hw IS NOT NULL THEN hform ELSE nform END AS format, coalesce(ofps, hfps, nfps) AS fps FROM o"
)
def format_resolved(spark, sf_dir):
    """Options before headers before names."""
    k = F.col("o_orderkey")
    known = lambda when, width, form, fps, fps_when: F.struct(F.when(when, width).cast("long").alias("width"), F.when(when, width / 2).cast("long").alias("height"), F.when(form[1], form[0]).alias("format"), F.when(fps_when, fps).alias("fps"))
    option = known(k % 3 == 0, F.lit(640), ("gray8", (k % 3 == 0) & (k % 2 == 0)), "25", k % 5 == 0)
    header = known(k % 4 < 2, F.lit(1280), ("yuv444p8", k % 4 < 2), "30/1", k % 4 == 1)
    named = known(k % 7 > 2, F.lit(320), ("yuv420p8", k % 7 > 2), "60", k % 7 > 4)
    return table(spark, sf_dir, "orders").select(k.alias("id"), D.resolved(option, header, named).alias("r")).select("id", "r.*")


_FORMATS = ("yuv420p", "yuv420p10", "yuv422p12le", "yuv444p16", "gray8", "y10", "gbrp", "rgb24", "i210", "yuv420p9")
_TAKEN = {
    "av2": ("yuv420p8", "yuv420p10le", "yuv422p8", "yuv444p8", "gray8", "gray10le", "gbrp8", "rgb24", "yuv422p10le", "yuv420p8"),
    "vvc": ("yuv420p8", "yuv420p10le", "yuv422p12le", "yuv444p8", "gray8", "gray10le", "gbrp8", "gbrp8", "yuv422p10le", "yuv420p9le"),
}


@register(
    f", f AS (SELECT l_linestatus, l_partkey % 10 AS k FROM lineitem), n AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'av2' ELSE 'vvc' END AS codec, {list(_FORMATS)}[k + 1] AS source, CASE WHEN l_linestatus = 'F' THEN {list(_TAKEN['av2'])}[k + 1] ELSE {list(_TAKEN['vvc'])}[k + 1] END AS given FROM f)"
    " SELECT codec, source, given, count(*) AS n FROM n GROUP BY ALL"
)
def format_negotiated(spark, sf_dir):
    """The formats that two codecs are given for ten sources, with how many items each stands for."""
    names = F.array(*map(F.lit, _FORMATS))
    d = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "F", "av2").otherwise("vvc").alias("codec"), F.get(names, (F.col("l_partkey") % 10).cast("int")).alias("source"))
    return d.groupBy("codec", "source").agg(F.count("*").alias("n")).select("codec", "source", D.codec_format(F.col("codec"), F.col("source")).alias("given"), "n")


@register(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'av2' END AS codec, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_clerk_ END AS path, 'lossless' AS name, CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'off' ELSE '1' END AS value, o_orderkey % 3 <> 1 AS enabled FROM (SELECT o_orderkey, o_orderpriority || ':' || o_orderkey AS o_clerk_ FROM orders)"
)
def format_settings(spark, sf_dir):
    """Endpoints codec:path and settings name=value, with their switches."""
    k = F.col("o_orderkey")
    path = F.concat("o_orderpriority", F.lit(":"), k.cast("string"))
    text = F.when(k % 8 == 0, F.concat(F.lit(":"), path)).when(k % 4 == 0, "av2:").otherwise(F.concat(F.lit("av2:"), path))
    spec = F.when(k % 3 == 0, "lossless").when(k % 3 == 1, "lossless=off").otherwise("lossless=1")
    d = table(spark, sf_dir, "orders").select(k.alias("id"), D.endpoint(text).alias("e"), D.setting(spec).alias("s"))
    return d.select("id", "e.codec", "e.path", "s.name", "s.value", D.switch(F.col("s.value")).alias("enabled"))
