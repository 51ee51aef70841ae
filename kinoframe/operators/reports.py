"""Report operators on traces and logs: strict means, matched keys, frame limits, failure reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks a line as the reason of a failure, and what stands where there is no line. Fixed values.
ERROR_MARKERS = ("error:", "Error:", "panic", "FAIL:")
NO_REASON = "encoder command failed"
CELL = ("case", "frame", "sb_x", "sb_y")


def psnr_mean(values: DataFrame, key: str, x: str) -> DataFrame:
    """Mean by key: infinite if all values are, null if only some are."""
    infinite = F.abs(F.col(x)) == float("inf")
    mean = F.when(F.bool_and(infinite), F.lit(float("inf"))).when(F.bool_or(infinite), F.lit(None)).otherwise(F.avg(F.when(~infinite, F.col(x))))
    return values.groupBy(key).agg(F.count("*").alias("n"), mean.alias("mean"))


def matched_keys(sb: DataFrame, one: str, other: str) -> DataFrame:
    """Cells and bits of each case and source, and of those cells that both sources have."""
    cells = sb.groupBy("source", *CELL).agg(F.sum("bits").alias("bits"))
    both = sb.where(F.col("source").isin(one, other)).groupBy(*CELL).agg(F.countDistinct("source").alias("k")).where("k = 2").select(*CELL, F.lit(True).alias("hit"))
    d = cells.join(both, list(CELL), "left")
    return d.groupBy("case", "source").agg(F.count("*").alias("cells"), F.count("hit").alias("matched"), F.sum("bits").alias("bits"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("bits"))), F.lit(0)).alias("matched_bits"))


def first_frames(sb: DataFrame, most: int) -> DataFrame:
    """Rows and bits of the first `most` frames of each case, of all with 0; frames count from 1."""
    return (sb.where(F.col("frame") <= most) if most else sb).groupBy("case", "frame").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def failure_reasons(logs: DataFrame, key: str, text: str) -> DataFrame:
    """The first line of each log with an error marker, else its last line that is not blank."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trimmed)
    marked = lambda x: F.contains(x, F.lit(ERROR_MARKERS[0])) | F.contains(x, F.lit(ERROR_MARKERS[1])) | F.contains(x, F.lit(ERROR_MARKERS[2])) | F.contains(x, F.lit(ERROR_MARKERS[3]))
    d = logs.select(key, lines.alias("lines"))
    reason = F.coalesce(F.get(F.filter("lines", marked), F.lit(0)), F.try_element_at(F.filter("lines", lambda x: x != ""), F.lit(-1)), F.lit(NO_REASON))
    return d.select(key, reason.alias("reason"))
