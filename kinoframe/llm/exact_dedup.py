"""Exact deduplication by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 32 bytes hits a
pattern, so equal passages give equal chunks wherever they stand. Every
distinct chunk is shuffled once (copies collapse before the shuffle) to check
that its 64-bit hash names one content only; hashes that name several get a
rank within the hash, told to the texts that hold them. A document is then its ordered list of chunk
identifiers, and only these short lists are grouped and joined.

Nulls: a null text counts as empty; empty texts equal each other. A null
doc_id never wins against another id. Repeated rows (same id and text) count
in group_size; rows of one id and different texts belong to their texts' groups. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _GOLDEN, ROW, all_but_one, durable, mix, numbered, slices

MIN_CHUNK, MAX_CHUNK, MEAN_BITS, WINDOW = 256, 8192, 10, 32
_GEAR = mix(np.arange(256, dtype=np.uint64), _GOLDEN & 0xFFFF).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the 32 bytes that end there, built by doubling."""
    h, span = _GEAR[data], 1
    while span < WINDOW:
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    return h


def cuts(hits: np.ndarray, begin: int, end: int) -> list[int]:
    """Chunk ends of the bytes [begin, end), from the sorted positions that follow a pattern."""
    out, last = [], begin
    for at in hits.tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if at - last >= MIN_CHUNK and at < end:
            out.append(at)
            last = at
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if end > last:
        out.append(end)
    return out


def chunks_of(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text; joined they give the text again."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(data):
        return [[] for _ in texts]
    # a cut within 32 bytes of a text's start would depend on its neighbour; MIN_CHUNK rules it out
    hits = np.flatnonzero(rolling(data) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, begin = [], 0
    for text in texts:
        end = begin + len(text)
        lo, hi = np.searchsorted(hits, [begin + MIN_CHUNK, end])
        edges = [begin, *cuts(hits[lo:hi], begin, end)]
        out.append([text[a - begin : b - begin] for a, b in zip(edges, edges[1:], strict=False)])
        begin = end
    return out


def _names(parts: list[bytes], bits: int) -> list[int]:
    """Signed hashes of the parts, cut to the given number of bits."""
    return [(xxhash.xxh3_64_intdigest(p) >> (64 - bits)) - (1 << (bits - 1)) for p in parts]


def _recipes(bits: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                        pa.array([_names(c, bits) for c in chunks_of(texts)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "sha", "recipe"],
                )

    return run


def _chunks(bits: int, placed: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                for text, chunks in zip(texts, chunks_of(texts), strict=True):
                    sha = hashlib.sha256(text).digest() if placed else None
                    rows += [(h, c, sha, i) for i, (h, c) in enumerate(zip(_names(chunks, bits), chunks, strict=True))]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())]
                if placed:
                    arrays += [pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["h", "content", "sha", "at"][: len(arrays)])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    hash_bits narrows the chunk hash; results don't depend on it.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    recipes = durable(source.mapInArrow(_recipes(hash_bits), "doc_id long, sha binary, recipe array<long>"), "recipes")
    distinct = source.mapInArrow(_chunks(hash_bits, False), "h long, content binary").distinct()
    many = durable(distinct.groupBy("h").count().where("count > 1").select("h"), "ambiguous")
    if many.isEmpty():
        recipes = recipes.withColumn("ranks", F.array().cast("array<struct<at:int,rank:int>>"))
    else:
        placed = source.mapInArrow(_chunks(hash_bits, True), "h long, content binary, sha binary, at int")
        unsure = distinct.join(many, "h", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("content")))
        ranks = placed.join(unsure, ["h", "content"]).groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("at", "rank"))).alias("ranks"))
        recipes = recipes.join(ranks, "sha", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<at:int,rank:int>>")))
    groups = recipes.groupBy("recipe", "ranks").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return recipes.join(groups, ["recipe", "ranks"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the largest id (null is the least); all columns as they were."""
    rows = numbered(docs, "exact-rows")
    groups = exact_groups(rows, ROW, text_col).where("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group"))
    return rows.join(all_but_one(groups, rows, id_col, largest=True), ROW, "left_anti").select(*docs.columns)
