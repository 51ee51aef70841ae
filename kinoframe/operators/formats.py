"""Pixel formats, frame geometry, coding regions and quantizer mapping as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metadata import parse_pixel_format, rate

REGION = 64


def geometry(frames: DataFrame) -> DataFrame:
    """frames (id, name, width, height) with the parsed format, the bytes of a frame, of its luma and of each chroma plane, and whether sides are there and suit the sampling.

    Bytes that a 64-bit number does not hold are null. Packed formats count as one plane of three samples a place.
    """
    d = frames.withColumn("f", parse_pixel_format(F.col("name"))).select("id", "width", "height", "f.sampling", "f.depth", F.col("f.name").alias("canonical"))
    w, h, s, deep = F.col("width"), F.col("height"), F.col("sampling"), F.when(F.col("depth") > 8, 2).otherwise(1).cast("long")
    half = lambda c: F.floor((c + 1) / 2)
    chroma = F.when(s == "420", F.try_multiply(half(w), half(h))).when(s == "422", F.try_multiply(half(w), h)).when(s.isin("400", "rgb"), 0).otherwise(F.try_multiply(w, h))
    plane = lambda samples: F.when(s.isNotNull(), F.try_multiply(samples, deep))
    d = d.withColumns({"luma_bytes": plane(F.try_multiply(w, h)), "chroma_bytes": plane(chroma)})
    whole = F.when(s == "rgb", F.try_multiply("luma_bytes", F.lit(3).cast("long"))).otherwise(F.try_add("luma_bytes", F.try_multiply("chroma_bytes", F.lit(2).cast("long"))))
    fits = F.when(s == "420", (w % 2 == 0) & (h % 2 == 0)).when(s == "422", w % 2 == 0).otherwise(True)
    return d.select("id", "sampling", "depth", "canonical", whole.alias("frame_bytes"), "luma_bytes", "chroma_bytes", (s.isNotNull() & (w > 0) & (h > 0) & fits).alias("valid"))


def regions(frames: DataFrame) -> DataFrame:
    """One row a REGION x REGION region of each frame, in raster order, clipped to the picture."""
    last = lambda c: F.floor((F.col(c) - 1) / REGION)
    d = frames.select("id", "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), last("height"))).alias("r"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last("width"))).alias("c"))
    side = lambda c, i: F.least(F.lit(REGION), F.col(c) - REGION * F.col(i))
    return d.select("id", (F.col("r") * (last("width") + 1) + F.col("c")).alias("region"), (REGION * F.col("c")).alias("x"), (REGION * F.col("r")).alias("y"), side("width", "c").alias("w"), side("height", "r").alias("h"))


def quantizers(rows: DataFrame, most: int = 255) -> DataFrame:
    """How often each qp occurs, its index min(ceil(10 qp / 3), most) and its lambda 2^(qp div 6) at 8 bits."""
    d = rows.groupBy("qp").agg(F.count("*").alias("n"))
    clamped = F.least(F.greatest(F.col("qp"), F.lit(0)), F.lit(63))
    return d.select("qp", "n", F.least(F.floor((10 * F.col("qp") + 2) / 3), F.lit(most)).alias("q_index"), F.expr("shiftleft(1L, cast(least(greatest(qp, 0), 63) div 6 as int))").alias("lambda"), clamped.alias("clamped"))


def parse_specs(rows: DataFrame) -> DataFrame:
    """rows (id, video, fps, qp: strings) parsed: WxH:format, rate as an exact fraction, qp of 1 to 255; null where it is none."""
    video = r"^\s*([0-9]+)x([0-9]+):\s*([A-Za-z0-9]+)\s*$"
    part = lambda i: F.when(F.col("video").rlike(video), F.regexp_extract("video", video, i))
    fps = rate(F.col("fps"))
    qp = F.col("qp").try_cast("long")
    return rows.select("id", part(1).try_cast("long").alias("width"), part(2).try_cast("long").alias("height"), F.lower(part(3)).alias("format"), fps["num"].alias("fps_num"), fps["den"].alias("fps_den"), F.when(qp.between(1, 255), qp).alias("qp"))


def integer_sizes(rows: DataFrame) -> DataFrame:
    """For sizes n: canvas (up to a multiple of 8), log2 rounded up and its power, and the code lengths of n in
    exponential Golomb and, with 2 low bits, Rice codes."""
    up = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("long")
    d = rows.withColumns({"canvas": F.floor((F.col("n") + 7) / 8) * 8, "log2_up": up})
    golomb, rice = F.length(F.bin(F.col("n") + 1)).cast("long") * 2 - 1, F.floor(F.col("n") / 4) + 3
    return d.withColumns({"power_up": F.expr("shiftleft(1L, cast(log2_up as int))"), "golomb_bits": golomb, "rice_bits": rice})
