"""Work on groups that Spark has dealt out and sorted: streams of groups, links inside a group, components.

Rows of a group come next to each other (repartition by its key, then sort
within partitions), so a task holds one group at a time. Callers split large
groups into blocks and deal out pairs of blocks: what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release

#: Rows, and tokens of their sets, of a block on the average.
BLOCK_ROWS, BLOCK_TOKENS = 1024, 1 << 21
#: Cells of a 0/1 matrix that are held at once, and its rows that are multiplied at once.
CELLS, STRIP = 1 << 24, 512
#: Edges of a graph that one task takes whole: some 32 MB.
EDGES_AT_ONCE = 2_000_000

#: From the table of one group to a batch of results.
GroupWork = Callable[[pa.Table], Iterator[pa.RecordBatch]]


def blocks_for(rows: Column, tokens: Column, block_rows: int | None = None) -> Column:
    """In how many blocks a group of so many rows and tokens is cut."""
    return F.ceil(F.greatest(rows / (block_rows or BLOCK_ROWS), tokens / BLOCK_TOKENS, F.lit(1))).cast("int")


def changes(table: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """The places at which a new key begins, but for the first row."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        x = table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def by_group(keys: list[str], work: GroupWork):
    """A function for mapInArrow over sorted rows: work is called with the table of each group (keys without nulls)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
                yield from work(pa.Table.from_batches(held))
                held = []
            cuts = changes(batch, keys).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                held.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield from work(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def whole_groups(batches, keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, many at once: `rows` or more, but for the last (keys without nulls)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        cut = changes(table, keys)
        if len(cut):
            yield table.slice(0, int(cut[-1]))
            table = table.slice(int(cut[-1]))
        held, size = table.to_batches(), table.num_rows
    if held:
        yield pa.Table.from_batches(held)


def overlaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many tokens each two of the sets share (below 2^24), as a matrix; tokens of a set are distinct."""
    g = len(offsets) - 1
    out = np.zeros((g, g), np.float32)
    row = np.repeat(np.arange(g), np.diff(offsets))
    order = np.argsort(tokens)
    value, row = tokens[order], row[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(value), 1), bool), value[1:] != value[:-1]]))
    n = np.diff(np.append(first, len(value)))
    column = np.repeat(np.cumsum(n > 1) - 1, n)
    use = np.repeat(n > 1, n)  # a token of one set is shared by none
    row, column = row[use], column[use]
    wide = max(1, CELLS // max(g, 1))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [a, a + wide])
        x = np.zeros((g, min(wide, int(column[-1]) + 1 - a)), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        for r in range(0, g, STRIP):
            out[r : r + STRIP] += x[r : r + STRIP] @ x.T
    return out


def similar(tokens: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Which two of the sets have a Jaccard similarity of percent / 100 or more; no set with itself, none that is empty."""
    both, n = overlaps(tokens, offsets), np.diff(offsets)
    link = np.zeros(both.shape, bool)
    for r in range(0, len(n), STRIP):
        k = both[r : r + STRIP].astype(np.int64)
        link[r : r + STRIP] = (k > 0) & (100 * k >= percent * (n[r : r + STRIP, None] + n[None, :] - k))
    np.fill_diagonal(link, False)
    return link


def join_up(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The forest `parent`, flat and of least members, with the links (a, b) added."""
    while True:
        x, y = parent[a], parent[b]
        live = x != y
        if not live.any():
            return parent
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further


def _forest(batches):
    """A task's edges as stars: every id it has seen, but for the least of its component there, with that least one."""
    tables = [b.select(["a", "b"]) for b in batches if b.num_rows]
    if tables:
        table = pa.Table.from_batches(tables)
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = join_up(np.arange(len(ids)), at[: len(a)], at[len(a) :])
        member = np.flatnonzero(parent != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[parent[member]]), pa.array(ids[member])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for all ids of an edge.

    Up to EDGES_AT_ONCE edges are one task's work. More are dealt out under both of their ids, so edges that share an
    id meet, and every task makes stars of what it has; rounds go on until the stars are whole. Those tasks are of
    Spark's advisory size: a hot id is split over several, whose stars meet in the next round.
    """
    edges = durable(edges.where("a != b").select("a", "b"), "edges")
    while True:
        whole = edges.count() <= EDGES_AT_ONCE
        dealt = edges.coalesce(1) if whole else edges.withColumn("key", F.col("a")).union(edges.withColumn("key", F.col("b"))).hint("rebalance", "key")
        stars = dealt.mapInArrow(_forest, "a long, b long")
        stars = durable(stars if whole else stars.distinct(), "stars")
        release(edges)
        edges = stars
        if whole:
            break
        twice = stars.groupBy("b").count().where("count > 1").select(F.col("b").alias("id"))
        inner = stars.select(F.col("a").alias("id")).distinct().join(stars.select(F.col("b").alias("id")), "id", "left_semi")
        if not twice.union(inner).head(1):
            break
    least = stars.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    return stars.select(F.col("b").alias("id"), F.col("a").alias("component")).union(least)
