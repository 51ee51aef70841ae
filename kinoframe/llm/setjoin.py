"""Exact set-similarity self-join: prefix, length and positional filters, links counted in families.

Tokens are ordered by rarity, rarest first. Two sets of a Jaccard similarity
of t or more share a token among the first n - ceil(t n) + 1 of each, at places
that leave room for the overlap they need. Any total order finds all such
pairs, so rarity may be read from a table of fixed size: tokens hash to 2^22
counters, kept as logarithms, and then to 35 bits.

A posting is a prefix token with its set's name, size and place, and 64 bits
in which each token of the set flips one: sets that differ in d tokens differ
in d bits at most. Sets of more than LONG tokens have 256 bits, the 64 being
their four words laid over one another. Spark deals postings out by token. A task compares those of
a token, drops pairs that fail a filter, and gives links that hold the rest
together: fewer than it has postings, however many pairs there are. A token
with more than MOST_POSTINGS postings goes on to a second pass, dealt out in
pairs of blocks. Sets held together form families, so similar sets are of one
family. A family comes together once (a large one in pairs of blocks) and all
its sets are compared whole: counts of links leave the task, pairs don't.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ragged, release, slices
from .groups import changes, components, join_up

COUNTERS, BLOCK, RANKS = 1 << 22, 1 << 12, 8
MOST_POSTINGS, PAIRS_AT_ONCE, ROWS_AT_ONCE = 2048, 1 << 21, 100_000
HASH_BITS, RANK_BITS, LONG = 35, 8, 72
_MASK = np.uint64(COUNTERS - 1)

#: From texts to (flat distinct token hashes, offsets, names of the sets), all numpy.
Sets = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Counters:
    """How often the tokens of a task hash to each of the counters."""

    def __init__(self):
        self.n = np.zeros(COUNTERS, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        np.add.at(self.n, (tokens & _MASK).astype(np.int64), 1)

    def rows(self, step: int = 1 << 16):
        """(bucket, n) of the counters in use, in batches of arrays."""
        at = np.flatnonzero(self.n)
        for a in range(0, len(at), step):
            yield at[a : a + step].astype(np.int32), self.n[at[a : a + step]]


def _block(table: pa.Table) -> pa.Table:
    at, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    out = np.zeros(BLOCK, np.uint8)
    out[at % BLOCK] = np.minimum(np.floor(RANKS * np.log2(n)), 255)
    return pa.table({"block": pa.array([int(at[0]) // BLOCK], pa.int32()), "ranks": pa.array([out.tobytes()], pa.binary())})


def rarity(counted: DataFrame) -> np.ndarray:
    """8 log2 of the counts of all tokens from rows (bucket, n): 4 MB, whatever the input. 0: a token counted once or never."""
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    blocks = summed.groupBy(F.floor(F.col("bucket") / BLOCK).alias("b")).applyInArrow(_block, "block int, ranks binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for row in blocks:
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["ranks"], np.uint8)
    return out


def flipped(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits of each set, shape (4, sets): all in one word, then words 1 to 3 of four for long sets, 0 for others."""
    n = np.diff(offsets)
    out = np.zeros((4, len(n)), np.uint64)

    def words(flat: np.ndarray, begin: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
        bit = np.uint64(1) << (flat >> np.uint64(58))
        return np.bitwise_xor.reduceat(np.append(bit if use is None else np.where(use, bit, np.uint64(0)), np.uint64(0)), begin)

    full, long = np.flatnonzero(n), np.flatnonzero(n > LONG)
    if len(full):
        out[0, full] = words(flat, offsets[full])
    if len(long):
        part = flat[ragged(offsets[long], n[long])]
        word = part >> np.uint64(56) & np.uint64(3)
        begin = np.cumsum(n[long]) - n[long]
        for k in (1, 2, 3):
            out[k, long] = words(part, begin, word == k)
    return out


def prefix_postings(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """token, set number, size and place of the postings of some sets; and the bits of each set."""
    n = np.diff(offsets)
    out, shift, width = [], np.uint64(HASH_BITS + RANK_BITS), 1 << (64 - HASH_BITS - RANK_BITS)
    for low in range(0, len(n), width):  # sets whose numbers fit beside a token
        high = min(low + width, len(n))
        tokens = flat[offsets[low] : offsets[high]]
        here = n[low:high]
        ranked = table[(tokens & _MASK).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS) | tokens >> np.uint64(64 - HASH_BITS)
        ordered = np.sort(np.repeat(np.arange(high - low).astype(np.uint64), here) << shift | ranked)
        row = (ordered >> shift).astype(np.int64)
        place = np.arange(len(ordered)) - (offsets[low:high] - offsets[low])[row]
        prefix = here - (percent * here + 99) // 100 + 1
        use = (place < prefix[row]) & (ordered >> np.uint64(HASH_BITS) & np.uint64(255) > 0)  # a token counted once joins nothing
        row = row[use]
        out.append(((ordered[use] & (np.uint64(1) << shift) - np.uint64(1)).view(np.int64), row + low, here[row], place[use]))
    token, row, size, place = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*out, strict=True) if out else [[]] * 4))
    return token, row, size, place, flipped(flat, offsets).view(np.int64)


def _postings(sets: Sets, ranks, percent: int):
    def run(batches):
        table = ranks.value
        for batch in batches:
            for part in slices(batch):
                flat, offsets, names = sets(part)
                _, first = np.unique(names, return_index=True)  # a repeated set is given once a slice
                new = np.zeros(len(names), bool)
                new[first] = True
                n = np.diff(offsets)
                flat = flat[np.repeat(new, n)]
                token, row, size, place, bits = prefix_postings(flat, np.concatenate([[0], np.cumsum(n[new])]), table, percent)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(names[new][row]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(x[row]) for x in bits)], names=list(FIELDS))

    return run


def held_together(group: np.ndarray, name: np.ndarray, n: np.ndarray, place: np.ndarray, bits: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of names that connect all that pass the filters within a group; rows are sorted by group and n."""
    names, node = np.unique(name, return_inverse=True)
    parent, at = np.arange(len(names)), group << 32
    begin, end = np.arange(len(n)) + 1, np.searchsorted(at | n, at | (100 * n // percent), side="right")
    many = np.maximum(end - begin, 0)
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, int(many.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE)) + 1
    low = 0
    for high in [*cuts.tolist(), len(n)]:
        x, y = np.repeat(np.arange(low, min(high, len(n))), many[low:high]), ragged(begin[low:high], many[low:high])
        low = high
        need = percent * (n[x] + n[y])
        fits = (100 + percent) * np.minimum(n[x] - place[x], n[y] - place[y]) >= need
        x, y, need = x[fits], y[fits], need[fits]
        # |x & y| = (|x| + |y| - d) / 2, and d is at least the number of bits that differ
        differ = [(b[x] ^ b[y]).view(np.uint64) for b in bits]
        d = np.bitwise_count(differ[0]).astype(np.int64)
        both_long = np.minimum(n[x], n[y]) > LONG
        four = [differ[0] ^ differ[1] ^ differ[2] ^ differ[3], *differ[1:]]
        d = np.where(both_long, sum(np.bitwise_count(w).astype(np.int64) for w in four), d)
        use = (100 + percent) * (n[x] + n[y] - d) >= 2 * need
        parent = join_up(parent, node[x[use]], node[y[use]])
    moved = np.flatnonzero(parent != np.arange(len(names)))
    return names[parent[moved]], names[moved]


FIELDS = ("token", "name", "n", "place", "bits", "bits1", "bits2", "bits3")
POSTING = "token long, name long, n int, place int, bits long, bits1 long, bits2 long, bits3 long"
PASSED = f"kind int, {POSTING}, block int"
EDGE, HOT, TOTAL = 0, 1, 2


def _batch(kind: int, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    types = {"token": pa.int64(), "name": pa.int64(), "n": pa.int32(), "place": pa.int32(), **{c: pa.int64() for c in FIELDS[4:]}, "block": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *(pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in types.items())], names=["kind", *types])


def _linked(keys: list[str], percent: int, most: int | None):
    """Links of each group of sorted postings; a group of more than `most` goes on, in numbered blocks and a row with their number."""

    def run(batches):
        held, size, hot = [], 0, None  # hot: the key of a group that goes on, and how many of its rows have gone

        def total():
            return _batch(TOTAL, token=np.array([hot[0]]), block=np.array([(hot[1] - 1) // most + 1], np.int32))

        def give(table: pa.Table, whole: bool):
            nonlocal hot
            if hot is not None and hot[0] != table.column("token")[0].as_py():
                yield total()
                hot = None
            c = {k: table.column(k).to_numpy() for k in dict.fromkeys([*keys, *FIELDS])}
            same = np.ones(max(table.num_rows - 1, 0), bool)
            for k in dict.fromkeys([*keys, "n", "name"]):
                same &= c[k][1:] == c[k][:-1]
            c = {k: x[np.concatenate([[True], ~same])] for k, x in c.items()}  # a set that several slices gave; sorted, so the least place is first
            cut = np.concatenate([[0], changes(table.select(keys).filter(pa.array(np.concatenate([[True], ~same]))), keys), [len(c["n"])]]).astype(np.int64)
            sizes, go = np.diff(cut), np.zeros(len(cut) - 1, bool)
            if most:
                go = sizes > most
                if hot is not None or not whole:
                    # the first group may have begun before this table, the last go on after it
                    go[0] |= hot is not None and hot[0] == c["token"][0]
                    go[-1] |= not whole
            group = np.repeat(np.arange(len(sizes)), sizes)
            for g in np.flatnonzero(go).tolist():
                token, rows = int(c["token"][cut[g]]), slice(cut[g], cut[g + 1])
                done = hot[1] if hot is not None and hot[0] == token else 0
                yield _batch(HOT, **{k: c[k][rows] for k in FIELDS}, block=((done + np.arange(sizes[g])) // most).astype(np.int32))
                hot = (token, done + int(sizes[g]))
                if whole or g < len(sizes) - 1:
                    yield total()
                    hot = None
            stay = ~go[group]
            x = [c[k][stay].astype(np.int64) for k in FIELDS]
            a, b = held_together(group[stay], *x[1:4], x[4:], percent)
            yield _batch(EDGE, token=a, name=b)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            cut = changes(table, keys)
            last = int(cut[-1]) if len(cut) else 0
            if last:
                yield from give(table.slice(0, last), True)
            held, size = table.slice(last).to_batches(), table.num_rows - last
            if most and size > ROWS_AT_ONCE // 2:
                yield from give(table.slice(last), False)
                held, size = [], 0
        if held:
            yield from give(pa.Table.from_batches(held), True)
        elif hot is not None:
            yield total()

    return run


def families(units: DataFrame, sets: Sets, percent: int, counted: DataFrame) -> DataFrame:
    """(id, component) of the names of all sets that a link of percent / 100 or more may hold to another.

    counted: (bucket, n) of the tokens of the sets, by Counters. Sets of one name count as one.
    """
    ranks = units.sparkSession.sparkContext.broadcast(rarity(counted))  # 4 MB
    rows = units.mapInArrow(_postings(sets, ranks, percent), POSTING)
    order = ["n", "name", "place"]
    passed = durable(rows.repartition("token").sortWithinPartitions("token", *order).mapInArrow(_linked(["token"], percent, MOST_POSTINGS), PASSED), "postings")
    edges = passed.where(F.col("kind") == EDGE).select(F.col("token").alias("a"), F.col("name").alias("b"))
    totals = passed.where(F.col("kind") == TOTAL).select("token", F.col("block").alias("blocks"))
    again = None
    if totals.head(1):
        hot = passed.where(F.col("kind") == HOT).select(*FIELDS, "block").join(totals, "token").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hot = hot.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        keys = ["token", "lo", "hi"]
        again = durable(hot.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_linked(keys, percent, None), PASSED), "hot-postings")
        edges = edges.union(again.select(F.col("token").alias("a"), F.col("name").alias("b")))
    out = components(edges)
    for table in (passed, again):
        if table is not None:
            release(table)
    return out
