"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

The sketch of a shingle set has t coordinates. In round i every shingle hashes
to one bin and a value in [i, i + 1); a bin keeps its least value, and rounds
go on until no bin is empty. From round t on, bin i - t takes every shingle,
so all fill. Equal coordinates estimate the Jaccard similarity with
concentration bounds like t independent minima. There are as many bands of 5
coordinates as meet a pair at the threshold with a probability of 1 - 1e-6.

Copies (equal sets) count once, by their smallest id. The documents that share
a bucket form a group with the smallest id of it, their leader. Each document's
full set is sent once to every group it is in, and all of the group are compared
there on full sets, as a product of 0/1 matrices. A large group is cut into
blocks that each hold the leader, so it costs its size; where it then still has
several components, the documents outside its largest one meet all of the group
in pairs of blocks. Every two documents that share a bucket are so compared,
unless links already hold them together, and no pair is ever made a row.

Nulls: a null text has no words; without words a document links with nothing.
Rows of one doc_id are one document as to its component, which has the links of
all their texts; a row with a null id has no component and links with nothing.
Words are split at ASCII white space and lower-cased in A-Z only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Words, all_but_one, distinct, durable, mix, numbered, release, slices
from .groups import blocks_for, by_group, components, join_up, similar

ROWS, MISS = 5, 1e-6
#: Characters whose sets a task holds at once when it sends them out.
SHIP_CHARS = 500_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    h = words.hashes()[:, 0]
    grams = np.zeros(0, np.uint64)
    if len(h) >= k:
        grams = mix(h[: len(h) - k + 1], 1)
        for j in range(1, k):
            grams = mix(grams ^ h[j : len(h) - k + 1 + j], j + 1)
    out = []
    for a, b in zip(words.offsets, words.offsets[1:], strict=False):
        if b - a >= k:
            out.append(distinct(grams[a : b - k + 1]))
        elif b > a:
            short = np.uint64(int(b - a) * 1_000_003)
            for x in h[a:b]:
                short = mix(np.array([short ^ x]), 99)[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)) if percent < 100 else 1


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The sketch of each set, one row each; rows of empty sets stay empty."""
    out = np.full((len(sets), size), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), lengths)
    for i in range(2 * size):
        if not len(x):
            break
        h = mix(x, 1000 + i)
        column = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        value = np.uint64(i << 48) | (h & np.uint64((1 << 48) - 1))
        np.minimum.at(flat, row * size + column, value)
        left = (out == _EMPTY).any(axis=1)[row]
        x, row = x[left], row[left]
    return out


def _band_keys(sketch: np.ndarray) -> np.ndarray:
    bands = sketch.shape[1] // ROWS
    keys = np.zeros((len(sketch), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sketch), b, np.uint64)
        for r in range(ROWS):
            key = mix(key ^ sketch[:, b * ROWS + r], b + 1)
        keys[:, b] = key
    return keys.view(np.int64)


def _sketcher(k: int, bands: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                keys = _band_keys(sketches(sets, bands * ROWS))
                digest = np.array([[xxhash.xxh3_128_intdigest(s) >> 64, xxhash.xxh3_128_intdigest(s) & (2**64 - 1)] for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest[:, 0].copy()),
                        pa.array(digest[:, 1].copy()),
                        pa.array([x if len(s) else [] for x, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def _shipper(k: int):
    """A row for each tag (leader, lo, hi, component) of a document, with the document's whole set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=SHIP_CHARS):
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), k)]
                tags = part.column("tags")
                row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(tags.offsets.to_numpy())))
                tag = tags.flatten()
                yield pa.RecordBatch.from_arrays([*(tag.field(c) for c in ("leader", "lo", "hi", "component")), part.column("id").take(row), pa.array(sets, pa.binary()).take(row)], names=["leader", "lo", "hi", "component", "id", "tokens"])

    return run


def _linker(percent: int):
    """Of a group's links those that join two of its components, each once."""

    def link(table: pa.Table):
        ids, component = (table.column(c).to_numpy() for c in ("id", "component"))
        lengths = pc.binary_length(table.column("tokens")).to_numpy() // 8
        tokens = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=np.uint64)
        if (component != component[0]).any():
            a, b = np.nonzero(np.triu(similar(tokens, np.concatenate([[0], np.cumsum(lengths)]), percent)))
            _, known = np.unique(component, return_inverse=True)
            _, first = np.unique(known, return_index=True)
            before = join_up(np.arange(len(ids)), first[known], np.arange(len(ids)))
            after = join_up(before.copy(), a, b)
            new = np.flatnonzero((after != before) & (before == np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[after[new]]), pa.array(ids[new])], names=["a", "b"])

    return link


def _links(source: DataFrame, tagged: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of different components among the documents that share a tag (leader, lo, hi): rows (id, leader, lo, hi, component)."""
    tags = tagged.groupBy("id").agg(F.collect_list(F.struct("leader", "lo", "hi", "component")).alias("tags"))
    shipped = source.join(tags, source["doc_id"] == tags["id"]).select("id", "text", "tags").mapInArrow(_shipper(shingle), "leader long, lo int, hi int, component long, id long, tokens binary")
    key = ["leader", "lo", "hi"]
    return durable(shipped.repartition(*key).sortWithinPartitions(*key).mapInArrow(by_group(key, _linker(percent)), "a long, b long"), "links")


def _round_of_blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Tags for the first round: each document with its leader, a large group in blocks that all hold the leader."""
    cut = members.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    all_of_them = F.sequence(F.lit(0), F.col("blocks") - 1)
    cut = cut.withColumn("lo", F.explode(F.when(F.col("id") == F.col("leader"), all_of_them).otherwise(F.array(own))))
    return cut.select("id", "leader", "lo", F.col("lo").alias("hi"), F.col("id").alias("component"))


def _round_of_pairs(members: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """Tags for the second round: in each large group still of several components, the blocks outside its largest
    component meet one another and every block of that component."""
    m = members.join(large.select("leader"), "leader").join(labels, "id", "left").select("leader", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    per = m.groupBy("leader", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    whole = per.groupBy("leader").agg(F.max_by("component", "n").alias("main"), F.max("n").alias("n_main"), F.max_by("t", "n").alias("t_main"), F.sum("n").alias("n"), F.sum("t").alias("t")).where("n > n_main")
    whole = whole.select("leader", "main", blocks_for(F.col("n") - F.col("n_main"), F.col("t") - F.col("t_main")).alias("out"), blocks_for(F.col("n_main"), F.col("t_main")).alias("within"))
    m = m.join(whole, "leader")
    outside, h = F.col("component") != F.col("main"), F.xxhash64("id")
    m = m.withColumn("own", F.when(outside, F.pmod(h, F.col("out"))).otherwise(F.col("out") + F.pmod(h, F.col("within"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(outside, F.col("out") + F.col("within")).otherwise(F.col("out")) - 1)
    m = m.withColumn("other", F.explode(others))
    return m.select("id", "leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "component")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; links at Jaccard >= percent / 100."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = durable(source.mapInArrow(_sketcher(shingle, bands_for(percent)), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketches")
    key = ["k1", "k2", "n_shingles"]
    first = sketched.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copied = first.where("copies > 1").drop("copies")
    placed = durable(sketched.join(copied, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands")), "placed")
    release(sketched)
    rows = placed.where("bands is not null").select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), "n_shingles")
    shared = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
    members = durable(rows.join(shared, "key").select("leader", "id", "n_shingles").distinct(), "members")
    weight = members.groupBy("leader").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t"))
    large = durable(weight.select("leader", blocks_for(F.col("n"), F.col("t")).alias("blocks")).where("blocks > 1"), "large")
    # an id whose rows have several texts is one document: it holds their groups of copies together
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    own = placed.join(several, "doc_id").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = _links(source, _round_of_blocks(members, large), shingle, percent)
    edges = links.union(own)
    labels = components(edges)
    if large.head(1):
        more = _links(source, _round_of_pairs(members, large, labels), shingle, percent)
        if more.head(1):
            labels = components(edges.union(more))
        release(more)
    for table in (members, large, links):
        release(table)
    out = placed.select("doc_id", "n_shingles", "rep").join(labels, F.col("rep") == labels["id"], "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each near-duplicate group, that of the least id (null is the largest); all columns as they were."""
    rows = numbered(docs, "near-rows")
    groups = near_groups(rows, shingle, percent, ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    return rows.join(all_but_one(groups, rows, id_col, largest=False), ROW, "left_anti").select(*docs.columns)
