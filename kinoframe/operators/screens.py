"""Screen content: texts as runs of 64-character tiles, matched whole; and the names of video files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 64


def tiles(docs: DataFrame) -> DataFrame:
    """(frame, at, tile): each document is a frame, cut into tiles of 64 characters, the last one filled with spaces."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))
    return docs.select(F.col("doc_id").alias("frame"), F.posexplode(cut).alias("at", "tile")).select("frame", F.col("at").cast("long").alias("at"), F.rpad("tile", TILE, " ").alias("tile"))


def tile_modes(docs: DataFrame) -> DataFrame:
    """For each frame: its tiles, those that a frame of a smaller id has anywhere, those that the frame before (id - 1)
    has in place, and the mode: empty, unchanged, partial or new.

    Tiles are compared whole. The first frame of a tile comes from a grouping, so equal tiles are never paired.
    """
    t = tiles(docs)
    first = t.groupBy("tile").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).where("first < last").drop("last")
    before = t.select((F.col("frame") + 1).alias("frame"), "at", F.col("tile").alias("was"))
    d = t.join(before, ["frame", "at"], "left").join(first, "tile", "left")
    per = d.groupBy("frame").agg(F.count("*").alias("n_tiles"), F.count_if(F.col("first") < F.col("frame")).alias("seen"), F.count_if(F.col("was") == F.col("tile")).alias("still"))
    d = docs.select(F.col("doc_id").alias("frame")).join(per, "frame", "left").fillna(0, ["n_tiles", "seen", "still"])
    mode = F.when(F.col("n_tiles") == 0, "empty").when(F.col("still") == F.col("n_tiles"), "unchanged").when(F.col("seen") > 0, "partial").otherwise("new")
    return d.withColumn("mode", mode)


def file_name(stem: Column, width: Column, height: Column, fps: Column, frames: Column, form: Column) -> Column:
    """stem_WxH[_fps]_Nf[_format].yuv; a slash in fps is written as over."""
    return F.concat(F.concat_ws("_", stem, F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.replace(fps, F.lit("/"), F.lit("over")), F.concat(frames.cast("string"), F.lit("f")), form), F.lit(".yuv"))


def name_metadata(names: DataFrame) -> DataFrame:
    """What a file name says: width, height and frames (the first digits before an f); a .yuv of no format is yuv420p."""
    part = lambda pattern, k: F.nullif(F.regexp_extract("file", pattern, k), F.lit(""))
    sides = "([0-9]+)x([0-9]+)"
    d = names.withColumn("width", part(sides, 1).cast("long")).withColumn("height", part(sides, 2).cast("long")).withColumn("frames", part("([0-9]+)f", 1).cast("long"))
    found = part("_((?:yuv4(?:20|22|44)p|gray)[0-9]*(?:le)?)[_.]", 1)
    return d.withColumn("format", F.coalesce(found, F.when(F.col("width").isNotNull(), "yuv420p")))
