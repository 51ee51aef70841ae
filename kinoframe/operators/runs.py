"""Recorded runs of encoders: metrics of frames as lines and back, validation, comparison of sizes, changes against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import total
from .reports import NO_REASON, failure_reasons, psnr_mean

#: A metric in a log line. Fixed value.
METRIC = r"\bpsnr_all=(inf|[-+]?[0-9]*\.?[0-9]+)"
#: Verdicts of a validation, in the order in which they are looked for. Fixed values.
NO_OUTPUT = "encoder returned success but did not create output"
EMPTY_OUTPUT = "encoder returned success but output is empty"
NO_RECON = "encoder returned success but did not create internal reconstruction"
SOURCE_DIFFERS, SOURCE_MATCHES = "lossless reconstruction differs from source", "lossless reconstruction matches source"
NO_REFERENCE = "reference decoder returned success but did not create reconstruction"
EMPTY_REFERENCE = "reference decoder returned success but reconstruction is empty"
REFERENCE_DIFFERS = "reference reconstruction checksum differs from internal reconstruction"
REFERENCE_MATCHES = "reference reconstruction matches internal reconstruction"
AFTER_PACKING = " after planar GBR to packed rgb24 normalization"
PRODUCED = "encoded output and internal reconstruction were produced"


def psnr(sse: Column, samples: Column | int, most: int = 255) -> Column:
    """PSNR of a sum of squared errors; infinite without an error."""
    return F.when(sse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(most * most)) * samples / sse))


def frame_metrics(source: DataFrame, coded: DataFrame, planes: tuple[str, ...] = ("px", "cb", "cr"), most: int = 255) -> DataFrame:
    """frame, psnr_y, psnr_u, psnr_v, psnr_all of pictures against their reconstruction, both rows of blocks (frame, row, col, planes)."""
    key = ["frame", "row", "col"]
    return paired_metrics(source.select(*key, *planes).join(coded.select(*key, *(F.col(c).alias(f"_{c}") for c in planes)), key), planes, most)


def paired_metrics(d: DataFrame, planes: tuple[str, ...] = ("px", "cb", "cr"), most: int = 255) -> DataFrame:
    """frame_metrics of rows that hold a block's planes and, as _ and their names, those of its reconstruction: only sums are sent."""
    square = lambda c: total(F.transform(F.zip_with(c, f"_{c}", lambda a, b: (a - b).cast("long")), lambda e: e * e))
    sums = d.groupBy("frame").agg(*(F.sum(square(c)).alias(f"e{k}") for k, c in enumerate(planes)), *(F.sum(F.size(c)).alias(f"n{k}") for k, c in enumerate(planes)))
    all_ = [sum((F.col(f"{x}{k}") for k in range(1, len(planes))), F.col(f"{x}0")) for x in "en"]
    return sums.select("frame", *(psnr(F.col(f"e{k}"), F.col(f"n{k}"), most).alias(f"psnr_{name}") for k, name in zip(range(len(planes)), "yuv", strict=False)), psnr(*all_, most).alias("psnr_all"))


def decimals(value: Column, places: int = 3) -> Column:
    """A number with so many decimals, inf if it is infinite, n/a if there is none."""
    return F.when(value.isNull(), "n/a").when(F.abs(value) == float("inf"), "inf").otherwise(F.format_string(f"%.{places}f", value.cast("double")))


def signed(value: Column, places: int = 0) -> Column:
    """A change with its sign, n/a if there is none."""
    text = F.format_string(f"%+.{places}f", value.cast("double")) if places else F.format_string("%+d", value.cast("long"))
    return F.when(value.isNull(), "n/a").otherwise(text)


def metric_lines(metrics: DataFrame, frames: Column) -> DataFrame:
    """(log, at, line) of metrics (log, codec, at, bytes, psnr_y, psnr_u, psnr_v, psnr_all): one line a frame, as encoders print it; at counts from 1 to frames."""
    parts = [F.lit("frame: codec="), F.col("codec"), F.lit(" index="), F.col("at").cast("string"), F.lit("/"), frames.cast("string"), F.lit(" bits="), (F.col("bytes") * 8).cast("string"), F.lit(" bytes="), F.col("bytes").cast("string")]
    for name in ("y", "u", "v", "all"):
        parts += [F.lit(f" psnr_{name}="), decimals(F.col(f"psnr_{name}"))]
    return metrics.select("log", "at", F.concat(*parts).alias("line"))


def logged_psnr(logs: DataFrame, key: str, line: str) -> DataFrame:
    """key, n, mean of all psnr_all values in the lines of a log: infinite if all are, null if some are or there is none."""
    values = F.regexp_extract_all(line, F.lit(METRIC), F.lit(1))
    number = F.when(F.col("v") == "inf", F.lit(float("inf"))).otherwise(F.col("v").try_cast("double"))
    d = logs.select(key, F.explode_outer(values).alias("v")).select(key, number.alias("x"))
    found = psnr_mean(d.where("x is not null"), key, "x")
    return logs.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def with_deltas(results: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """results (keys, bytes, fps, psnr_all_mean) with delta_bytes, delta_fps and delta_psnr against the row of the baseline; null where there
    is none, and for PSNR where either is not finite."""
    old = baseline.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("bytes", "fps", "psnr_all_mean")))
    d = results.join(old, keys, "left")
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    change = F.when(finite("psnr_all_mean") & finite("_psnr_all_mean"), F.col("psnr_all_mean") - F.col("_psnr_all_mean"))
    d = d.withColumns({"delta_bytes": F.col("bytes") - F.col("_bytes"), "delta_fps": F.col("fps") - F.col("_fps"), "delta_psnr": change})
    return d.drop("_bytes", "_fps", "_psnr_all_mean")


def delta_label(bytes_: Column, fps: Column) -> Column:
    """The changes of a result as text, empty if there is none."""
    return F.when(bytes_.isNull(), "").otherwise(F.concat(F.lit(" bytes_delta="), signed(bytes_), F.lit(" fps_delta="), signed(fps, 2)))


def validation(runs: DataFrame) -> DataFrame:
    """vector, status, reason of recorded runs: PASS or FAIL by the first rule that is broken.

    runs: vector, returncode, log, output_bytes (null: no file), recon_bytes, recon_sha, source_bytes and source_sha (null: not
    lossless), mode (off, auto, on), decode_code, decode_log, reference_bytes, reference_sha, packed (the reference was brought to packed RGB).
    """
    why = failure_reasons(runs.withColumn("_why", F.when(F.col("returncode") != 0, F.col("log")).otherwise(F.col("decode_log"))), "vector", "_why").withColumnRenamed("reason", "_reason")
    d = runs.join(why, "vector", "left").withColumn("_reason", F.coalesce("_reason", F.lit(NO_REASON)))
    col, text = F.col, lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    lossless = col("source_sha").isNotNull()
    lengths = text("lossless reconstruction length differs from source (", col("recon_bytes").cast("string"), " != ", col("source_bytes").cast("string"), ")")
    skipped = (col("decode_code") == 2) & (col("mode") == "auto")
    rules = [
        (col("returncode") != 0, col("_reason")),
        (col("output_bytes").isNull(), F.lit(NO_OUTPUT)),
        (col("output_bytes") == 0, F.lit(EMPTY_OUTPUT)),
        (col("recon_sha").isNull(), F.lit(NO_RECON)),
        (lossless & (col("recon_bytes") != col("source_bytes")), lengths),
        (lossless & (col("recon_sha") != col("source_sha")), F.lit(SOURCE_DIFFERS)),
    ]
    decoded = [
        ((col("decode_code") != 0) & ~skipped, text("reference decode failed: ", col("_reason"))),
        ((col("decode_code") == 0) & col("reference_sha").isNull(), F.lit(NO_REFERENCE)),
        ((col("decode_code") == 0) & (col("reference_bytes") == 0), F.lit(EMPTY_REFERENCE)),
        ((col("decode_code") == 0) & (col("reference_sha") != col("recon_sha")), F.lit(REFERENCE_DIFFERS)),
    ]
    broken = F.coalesce(*(F.when(w, r) for w, r in [*rules, *((w & (col("mode") != "off"), r) for w, r in decoded)]))
    reference = F.when(skipped, text("reference decode skipped: ", col("_reason"))).otherwise(F.concat(F.lit(REFERENCE_MATCHES), F.when(col("packed"), AFTER_PACKING).otherwise("")))
    fine = F.when(col("mode") == "off", F.when(lossless, SOURCE_MATCHES).otherwise(PRODUCED)).otherwise(F.when(lossless, text(SOURCE_MATCHES, "; ", reference)).otherwise(reference))
    return d.select("vector", F.when(broken.isNotNull(), "FAIL").otherwise("PASS").alias("status"), F.coalesce(broken, fine).alias("reason"))


def comparison(sizes: DataFrame) -> DataFrame:
    """sizes (vector, frames, seconds, bytes, reference_bytes) with fps and ratio (infinite over nothing), and a row with a null vector for all: sums, and the ratio of sums."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("inf")))
    d = sizes.rollup("vector").agg(F.grouping("vector").alias("_all"), *(F.sum(c).alias(c) for c in ("frames", "seconds", "bytes", "reference_bytes")))
    return d.select("vector", "frames", "seconds", "bytes", "reference_bytes", over(F.col("frames"), F.col("seconds")).alias("fps"), over(F.col("bytes"), F.col("reference_bytes")).alias("ratio"))


def case_limit(cases: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` cases in order; 0 is all."""
    return cases.orderBy(*order).limit(most) if most else cases
