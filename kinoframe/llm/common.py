"""Helpers shared by the corpus operators: durable tables, words, hashing.

Words are maximal runs of anything but the six ASCII white-space characters,
so every operator and its SQL oracle split text alike.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that a Python task handles at once; one longer document is a slice alone.
SLICE_CHARS = 2_000_000

_own_root: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: one large file may be a single split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode with none set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_root.setdefault("dir", tempfile.mkdtemp(prefix="spark-kinoframe-", dir="/tmp"))


def tables_root(spark: SparkSession) -> str:
    """The folder of this application's durable tables in the shared one."""
    return f"{scratch_root(spark)}/kinoframe-{spark.sparkContext.applicationId}"


def purge(spark: SparkSession) -> None:
    """Delete all durable tables of this application, when no result of its operators is read any more."""
    _delete(spark, tables_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame, name: str, partition: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at files that survive executors."""
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    if _tracked:
        _tracked[-1].append(path)
    return out


_tracked: list[list[str]] = []


@contextmanager
def tracked(paths: list[str]) -> Iterator[None]:
    """Note in `paths` the durable tables that are written meanwhile."""
    _tracked.append(paths)
    try:
        yield
    finally:
        _tracked.pop()


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete the durable tables of these paths, which nothing reads any more, and empty the list."""
    while paths:
        _delete(spark, paths.pop())


#: A column that input tables are not expected to have.
ROW = "__kinoframe_row__"


def content_hash(df: DataFrame) -> Column:
    """A hash of a row's values (maps cannot be hashed)."""
    return F.xxhash64(*(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, durable, with a number of its own in ROW for each row, whatever its id."""
    return durable(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def all_but_one(groups: DataFrame, rows: DataFrame, id_col: str, largest: bool) -> DataFrame:
    """The numbers of all rows of groups (ROW, group) but one of each: that of the largest id (null is the least) or of the least one (null is the largest).

    Rows of one id are told apart by their content, then by number. Only ids, hashes and numbers are grouped; the rows
    that stay are found by their own number, so a large group is no hot key.
    """
    small = rows.select(ROW, F.col(id_col).alias("_id"), content_hash(rows.drop(ROW)).alias("_content"))
    members = durable(groups.join(small, ROW), "members")
    order = [F.col("_id"), F.col("_content"), F.col(ROW)]
    best = F.max(F.struct(*order)) if largest else F.min(F.struct(F.col("_id").isNull().alias("_none"), *order))
    stay = members.groupBy("group").agg(best.alias("b")).select(F.col(f"b.{ROW}").alias(ROW))
    return members.select(ROW).join(stay, ROW, "left_anti")


def release(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    _delete(df.sparkSession, df._durable_path)


def words_of(text: Column) -> Column:
    """array<string> of a text's words; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with a bounded amount of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


class Words:
    """The words of a slice of texts: per-word codes into the distinct words, per-text offsets."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        real = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(real).as_py() and len(flat):
            flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: pa.Array = coded.dictionary
        self.row = row
        self.counts = np.bincount(row, minlength=len(lists)).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """Two independent 64-bit hashes of every word occurrence, shape (words, 2)."""
        return hash128(self.distinct)[self.codes]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, salted: a fresh pseudo-random value for each x."""
    x = x + np.uint64((salt * _GOLDEN + _GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash128(values: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each string, shape (n, 2): eight bytes at a time, all strings at once."""
    n = len(values)
    if not n:
        return np.zeros((0, 2), np.uint64)
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    data, start = np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1] - offsets[0]
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    length = np.diff(offsets)
    out = np.stack([mix(length.astype(np.uint64), 3), mix(length.astype(np.uint64), 5)])
    at, k = np.arange(n), 0
    while len(at):
        at = at[length[at] > k] if k else at[length[at] > 0]
        rest = np.minimum(length[at] - k, 8).astype(np.uint64)
        chunk = eights[start[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[0, at] = mix(out[0, at] ^ chunk, 1)
        out[1, at] = mix(out[1, at] * np.uint64(0xD6E8FEB86659FD93) + chunk, 2)
        k += 8
    return out.T


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def lists_of(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
