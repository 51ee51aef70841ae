"""Reports over encoder traces: grouped summaries, pairings, top lists, pivots and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bridges import CATEGORIES

KEYS = ("case", "source", "frame")


def nearest_rank(column: str, p: float) -> Column:
    """The smallest value with a share p of all values at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def superblock_summary(sb: DataFrame) -> DataFrame:
    """A row a (case, source, frame): counts, sums and spread of bits, and the three categories of most bits (ties by name)."""
    ranked = F.array_sort(F.array(*(F.struct((-F.sum(c)).alias("less"), F.lit(c).alias("name")) for c in CATEGORIES)))
    return sb.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.sum("bits").alias("total_bits"),
        F.avg("bits").alias("mean_bits"),
        nearest_rank("bits", 0.95).cast("long").alias("p95_bits"),
        F.max("bits").alias("max_bits"),
        F.array_join(F.transform(F.slice(ranked, 1, 3), lambda t: F.concat(t["name"], F.lit("="), (-t["less"]).cast("string"))), ", ").alias("top_categories"),
    )


def category_rollup(sb: DataFrame) -> DataFrame:
    """One row a (case, source, category): bits, share of the larger of total and category sum, rank of three."""
    sums = sb.groupBy("case", "source").agg(F.sum("bits").alias("total"), *(F.sum(c).alias(c) for c in CATEGORIES))
    long = sums.withColumn("whole", F.greatest("total", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))))
    long = long.unpivot(["case", "source", "whole"], list(CATEGORIES), "category", "category_bits")
    rank = F.row_number().over(Window.partitionBy("case", "source").orderBy(F.desc("category_bits"), "category"))
    return long.withColumn("rank", rank.cast("long")).where("rank <= 3").select("case", "source", "category", "category_bits", (F.col("category_bits") / F.col("whole")).alias("share"), "rank")


def pairwise(sb: DataFrame, baseline: str) -> DataFrame:
    """Each other source against the baseline at equal superblocks, repeated keys summed first."""
    cell = sb.groupBy(*KEYS, "sb_x", "sb_y").agg(F.sum("bits").alias("bits"))
    base = cell.where(F.col("source") == baseline).drop("source").withColumnRenamed("bits", "base_bits")
    both = base.join(cell.where(F.col("source") != baseline), ["case", "frame", "sb_x", "sb_y"]).withColumn("delta", F.col("bits") - F.col("base_bits"))
    worst = F.max(F.struct("delta", (-F.col("sb_y")).alias("y"), (-F.col("sb_x")).alias("x"))).alias("w")
    d = both.groupBy(*KEYS).agg(F.count("*").alias("matched"), F.sum("base_bits").alias("base_bits"), F.sum("bits").alias("bits"), F.sum("delta").alias("delta"), worst)
    return d.select(*KEYS, "matched", "base_bits", "bits", "delta", F.col("w.delta").alias("worst_delta"), (-F.col("w.x")).alias("worst_x"), (-F.col("w.y")).alias("worst_y"))


def hot_superblocks(sb: DataFrame, n: int) -> DataFrame:
    """The n places of most bits of each case and source."""
    cell = sb.groupBy("case", "source", "sb_x", "sb_y").agg(F.sum("bits").alias("bits"), F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("case", "source").orderBy(F.desc("bits"), "sb_y", "sb_x"))
    return cell.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def field_summary(events: DataFrame) -> DataFrame:
    """Bits and count of each field name within a phase; bits are whole cents of value."""
    bits = F.round(F.col("value") * 100).cast("long")
    return events.groupBy(F.date_format("ts", "HH").alias("phase"), F.col("event_type").alias("name")).agg(F.sum(bits).alias("bits"), F.count("*").alias("records"))


def dynamic_keys(events: DataFrame) -> DataFrame:
    """Sums of every integer key of a JSON map."""
    pairs = events.select("event_type", F.explode(F.from_json("props", "map<string,long>")).alias("key", "v"))
    return pairs.groupBy("event_type", "key").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def stage_timing(orders: DataFrame) -> DataFrame:
    """By case and stage: time, calls, share of the case's time, time a call."""
    ns = F.floor("o_totalprice").cast("long")
    stages = orders.groupBy(F.col("o_orderstatus").alias("case"), F.col("o_orderpriority").alias("stage")).agg(F.sum(ns).alias("ns"), F.count("*").alias("calls"))
    whole = F.sum("ns").over(Window.partitionBy("case"))
    return stages.withColumns({"share": F.col("ns") / whole, "ns_per_call": F.col("ns") / F.col("calls")})


def tail_pivot(sb: DataFrame) -> DataFrame:
    """A column of bits for each source, and the share of one in both."""
    wide = sb.groupBy("case", "frame").pivot("source", ["F", "O"]).agg(F.sum("residual_bits"))
    f, o = F.coalesce("F", F.lit(0)), F.coalesce("O", F.lit(0))
    return wide.select("case", "frame", f.cast("long").alias("head_bits"), o.cast("long").alias("tail_bits"), F.when(f + o > 0, o / (f + o)).alias("tail_share"))


def matrix_totals(sb: DataFrame) -> DataFrame:
    """Detail rows by case and source, and a total of each case and of all: sums, and the ratio of sums."""
    d = sb.rollup("case", "source").agg(F.sum("bits").alias("bits"), F.sum("frame").alias("frames"), F.grouping_id().cast("long").alias("level"))
    return d.withColumn("bits_per_frame", F.col("bits") / F.col("frames"))


def baseline_delta(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """now with delta_bits against before; null where before has no such row."""
    old = before.select(*keys, F.col("bits").alias("_old"))
    return now.join(old, keys, "left").withColumn("delta_bits", F.col("bits") - F.col("_old")).drop("_old")


def enabled_cases(parts: DataFrame, codecs: DataFrame) -> DataFrame:
    """Codec by brand, enabled where the vector names no codec or this one; counts of both kinds."""
    # a codec's cases are those of its own and the free ones, so counts do and no pair is a row
    per = parts.groupBy("only").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("only").isNull(), F.col("n"))), F.lit(0)).alias("free")).withColumn("k", F.lit(1))
    d = codecs.select("codec", F.lit(1).alias("k")).join(whole, "k").join(per, F.col("codec") == F.col("only"), "left")
    enabled = F.col("free") + F.coalesce("n", F.lit(0))
    return d.select("codec", enabled.alias("enabled"), (F.col("all") - enabled).alias("skipped"))


def infinite_mean(values: DataFrame, key: str, x: str) -> DataFrame:
    """Mean of the finite values of each key (null where there is none), how many are infinite, and whether all are."""
    finite = F.abs(x) != float("inf")
    return values.groupBy(key).agg(F.count_if(~finite).alias("n_infinite"), F.avg(F.when(finite, F.col(x))).alias("finite_mean"), F.bool_and(~finite).alias("all_infinite"))


def counters(sb: DataFrame) -> DataFrame:
    """Total of each counter of a case and source, and its share of a frame that has any counter."""
    sums = sb.groupBy("case", "source").agg(F.countDistinct("frame").alias("frames"), *(F.sum(c).alias(c) for c in CATEGORIES))
    long = sums.unpivot(["case", "source", "frames"], list(CATEGORIES), "counter", "total")
    return long.select("case", "source", "counter", "total", (F.col("total") / F.col("frames")).alias("per_frame"))


def grand_total(sb: DataFrame, baseline: str, other: str) -> DataFrame:
    """Bits of two sources by case and in all (case null); ratios are of sums, null without baseline bits."""
    bits = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("bits"))), F.lit(0))
    d = sb.rollup("case").agg(bits(baseline).alias("base_bits"), bits(other).alias("bits"))
    return d.withColumn("ratio", F.when(F.col("base_bits") > 0, F.col("bits") / F.col("base_bits")))
