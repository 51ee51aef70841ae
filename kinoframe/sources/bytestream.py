"""Byte streams of units behind start codes, scanned by ranges: a large file is many tasks' work.

A start code is the bytes 0 0 1; with another 0 before it is four bytes long. Whether one begins at a place hangs on
four bytes only, so a range looks one byte back and a few on, and codes across two ranges are found once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import dealt
from .frames import place

#: Bytes of a range, and ranges that are looked through together when ends are carried on.
RANGE, RUN = 8 << 20, 4096
#: Highest layer id of a unit header. Fixed value.
LAST_LAYER = 55


def byte_ranges(listed: DataFrame, span: int = RANGE) -> DataFrame:
    """(path, length, part, begin, end): the files cut into ranges of `span` bytes."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / span) - 1))
    d = listed.where("length > 0").select("path", "length", parts.alias("part"))
    return d.select("path", "length", "part", (F.col("part") * span).alias("begin"), F.least((F.col("part") + 1) * span, "length").alias("end"))


def code_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the start codes in some bytes."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == 0) & (data[1:-1] == 0) & (data[2:] == 1))
    four = (at > 0) & (data[np.maximum(at - 1, 0)] == 0)
    return at - four, 3 + four.astype(np.int64)


def _scan(batches):
    for batch in batches:
        for row in batch.to_pylist():
            fs, name = place(row["path"])
            low, high = max(row["begin"] - 1, 0), min(row["end"] + 8, row["length"])
            with fs.open_input_file(name) as f:
                f.seek(low)
                data = np.frombuffer(f.read(high - low), np.uint8)
            at, size = code_places(data)
            mine = (at + low >= row["begin"]) & (at + low < row["end"])
            at, size = at[mine], size[mine]
            padded = np.concatenate([data, np.zeros(2, np.uint8)])
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["path"]] * n, pa.string()), pa.array([row["part"]] * n, pa.int64()), pa.array([row["length"]] * n, pa.int64()), pa.array(at + low), pa.array(at + low + size), *(pa.array(padded[at + size + k].astype(np.int64)) for k in (0, 1))],
                names=["path", "part", "length", "code", "offset", "h0", "h1"],
            )


def start_codes(ranges: DataFrame) -> DataFrame:
    """(path, part, length, code, offset, h0, h1): where each code begins and its unit, and the unit's first two bytes."""
    return dealt(ranges, "path", "part").mapInArrow(_scan, "path string, part long, length long, code long, offset long, h0 long, h1 long")


def units(ranges: DataFrame) -> DataFrame:
    """(path, offset, unit_type, layer_id, temporal_id, payload_len): the units of the files; a header that breaks the rules raises.

    A unit ends where the next code begins. In a run of ranges that is the row after; the last one of a run takes the first
    code of the next run that has one, from a table of one row a run.
    """
    d = start_codes(ranges).withColumn("run", F.floor(F.col("part") / RUN))
    firsts = d.groupBy("path", "run").agg(F.min("code").alias("first"))
    later = firsts.select(F.col("path").alias("p"), F.col("run").alias("r"), F.lead("first").over(Window.partitionBy("path").orderBy("run")).alias("later"))
    d = d.withColumn("following", F.lead("code").over(Window.partitionBy("path", "run").orderBy("code")))
    d = d.join(later, (F.col("path") == F.col("p")) & (F.col("run") == F.col("r"))).withColumn("end", F.coalesce("following", "later", "length"))
    bad = F.when(F.col("end") - F.col("offset") < 2, "unit is too short for a header").when(F.col("h0") >= 64, "reserved bits are set").when(F.col("h0") > LAST_LAYER, "layer id is out of range").when(F.col("h1") % 8 == 0, "temporal id is zero")
    where = F.concat(bad, F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), F.col("path"))
    checked = F.when(bad.isNotNull(), F.raise_error(where).cast("long")).otherwise(F.floor(F.col("h1") / 8))
    return d.select("path", "offset", checked.alias("unit_type"), F.col("h0").alias("layer_id"), (F.col("h1") % 8 - 1).alias("temporal_id"), (F.col("end") - F.col("offset") - 2).alias("payload_len"))
