"""The registered queries on screen content and file names, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import screens
from .plans.bridges import table
from .queries import register


@register(
    r", t0 AS (SELECT doc_id AS frame, regexp_extract_all(text, '(?s).{1,64}') AS c FROM documents WHERE text IS NOT NULL),"
    " t AS (SELECT frame, i - 1 AS at, rpad(c[i], 64, ' ') AS tile FROM (SELECT frame, c, unnest(range(1, len(c) + 1)) AS i FROM t0)),"
    " f AS (SELECT tile, min(frame) AS first FROM t GROUP BY 1),"
    " p AS (SELECT t.frame, count(*) AS n_tiles, count(*) FILTER (first < t.frame) AS seen, count(*) FILTER (b.tile = t.tile) AS still FROM t JOIN f USING (tile) LEFT JOIN t b ON b.frame = t.frame - 1 AND b.at = t.at GROUP BY 1),"
    " q AS (SELECT doc_id AS frame, coalesce(n_tiles, 0) AS n_tiles, coalesce(seen, 0) AS seen, coalesce(still, 0) AS still FROM documents LEFT JOIN p ON frame = doc_id)"
    " SELECT *, CASE WHEN n_tiles = 0 THEN 'empty' WHEN still = n_tiles THEN 'unchanged' WHEN seen > 0 THEN 'partial' ELSE 'new' END AS mode FROM q"
)
def screen_tile_modes(spark, sf_dir):
    return screens.tile_modes(table(spark, sf_dir, "documents"))


#: Rates and formats of made-up file names; null is left out of the name.
RATES, FORMATS = ("30000/1001", "50", None), ("yuv422p10le", None, "gray", "yuv444p")


@register(
    ", n AS (SELECT p_partkey AS id, concat(concat_ws('_', p_brand, concat(p_size * 8, 'x', p_size * 6), ['30000over1001', '50', NULL][p_partkey % 3 + 1], concat(p_partkey % 90 + 1, 'f'), ['yuv422p10le', NULL, 'gray', 'yuv444p'][p_partkey % 4 + 1]), '.yuv') AS file FROM part)"
    " SELECT id, file, nullif(regexp_extract(file, '([0-9]+)x([0-9]+)', 1), '')::BIGINT AS width, nullif(regexp_extract(file, '([0-9]+)x([0-9]+)', 2), '')::BIGINT AS height, nullif(regexp_extract(file, '([0-9]+)f', 1), '')::BIGINT AS frames,"
    " coalesce(nullif(regexp_extract(file, '_((?:yuv4(?:20|22|44)p|gray)[0-9]*(?:le)?)[_.]', 1), ''), CASE WHEN regexp_matches(file, '[0-9]+x[0-9]+') THEN 'yuv420p' END) AS format FROM n"
)
def format_file_names(spark, sf_dir):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    name = screens.file_name(F.col("p_brand"), F.col("p_size") * 8, F.col("p_size") * 6, pick(RATES), F.col("p_partkey") % 90 + 1, pick(FORMATS))
    return screens.name_metadata(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("file")))
