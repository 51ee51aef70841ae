"""Palettes of blocks and regions: the samples that stand for all others at the least sum of absolute differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours of a palette, and the least number: a flat block gets a second one that it does not use. Fixed values.
MOST, LEAST = 6, 2
#: Cells of the table of segments that are held at once.
CELLS = 1 << 22


def medians(px: np.ndarray, most: int) -> np.ndarray:
    """The colours of each row of samples, rising, padded with -1: shape (rows, most).

    The distinct samples of a row, in order, are cut into `most` segments so that the sum of the samples' distances to the
    lower median of their segment is least; of equal cuts the one whose last segments begin first. Rows of no more
    distinct samples keep them all.
    """
    rows, n = px.shape
    s = np.sort(px, axis=1).astype(np.int64)
    sums = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(s, axis=1)], axis=1)
    new = np.concatenate([np.ones((rows, 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
    count = new.sum(axis=1)
    width = int(count.max())
    out = np.full((rows, most), -1, np.int64)
    # the places in s at which the distinct samples begin, and n for all beyond the last
    begin = np.sort(np.where(new, np.arange(n), n), axis=1)[:, :width]
    begin = np.concatenate([begin, np.full((rows, 1), n)], axis=1)
    few = count <= most
    distinct = np.where(np.arange(width) < count[:, None], np.take_along_axis(s, np.minimum(begin[:, :width], n - 1), axis=1), -1)
    out[few, : min(width, most)] = distinct[few, :most]
    many = np.flatnonzero(~few)
    if len(many):
        out[many] = _cut(s[many], sums[many], begin[many], count[many], most)
    return out


def _cut(s: np.ndarray, sums: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    rows, n = s.shape
    width = begin.shape[1] - 1
    low, high = begin[:, :-1, None], begin[:, None, 1:]  # a segment is the samples [low, high): from distinct a to distinct b
    middle = np.minimum(low + (high - low + 1) // 2 - 1, n - 1)
    flat = np.clip(middle, 0, n - 1).reshape(rows, -1)
    median = np.take_along_axis(s, flat, axis=1).reshape(rows, width, width)
    at = lambda i: np.take_along_axis(sums, np.broadcast_to(i, (rows, width, width)).reshape(rows, -1), axis=1).reshape(rows, width, width)
    cost = median * (2 * middle + 2 - low - high) - 2 * at(np.clip(middle, 0, n - 1) + 1) + at(low) + at(high)
    never = np.int64(1) << 60
    cost = np.where(np.arange(width)[None, :, None] <= np.arange(width)[None, None, :], cost, never)
    best = [cost[:, 0, :]]  # of samples up to distinct b with one colour
    first = [np.zeros((rows, width), np.int64)]
    for _ in range(most - 1):
        before = np.concatenate([np.full((rows, 1), never), best[-1][:, :-1]], axis=1)  # up to the one before a
        total = np.minimum(before[:, :, None] + cost, never)
        first.append(total.argmin(axis=1))
        best.append(np.take_along_axis(total, first[-1][:, None, :], axis=1)[:, 0, :])
    out = np.full((rows, most), -1, np.int64)
    end, r = count - 1, np.arange(rows)
    for k in range(most - 1, -1, -1):
        a = first[k][r, end]
        out[:, k] = median[r, a, end]
        end = a - 1
    return out


def nearest(px: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """The place of each sample's nearest colour, the lower one of two."""
    far = np.where(colours[:, None, :] < 0, 1 << 40, np.abs(px[:, :, None] - colours[:, None, :]))
    return far.argmin(axis=2)


def _palettes(id_col: str, most: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("px")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                step = max(1, CELLS // max(n * n, 1))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    px = flat[start[part][:, None] + np.arange(n)]
                    colours = medians(px, most) if n else np.full((len(part), most), -1)
                    found = (colours >= 0).sum(axis=1)
                    if n:
                        colours[found == 1, 1] = np.where(colours[found == 1, 0] == 0, 1, 0)
                        colours = np.sort(np.where(colours < 0, 1 << 40, colours), axis=1)
                        colours[colours == 1 << 40] = -1
                        index = nearest(px, colours)
                        cost = np.abs(px - np.take_along_axis(colours, index, axis=1)).sum(axis=1)
                    else:
                        index, cost = px, np.zeros(len(part), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_col).take(pa.array(part)), pa.array([c[c >= 0].tolist() for c in colours], pa.list_(pa.int32())), pa.array(index.tolist(), pa.list_(pa.int32())), pa.array(cost)],
                        names=[id_col, "palette", "indices", "cost"],
                    )

    return run


def median_palettes(regions: DataFrame, id_col: str = "block_id", most: int = MOST) -> DataFrame:
    """id, palette, indices, cost: at most `most` colours of each region (id, px) of any size, each sample's nearest
    one (of two the lower), and the sum of absolute differences. An empty region has no colour.

    Regions are judged one by one, many at once in a task; there is no shuffle.
    """
    kind = regions.schema[id_col].dataType.simpleString()
    d = regions.select(id_col, F.col("px").cast("array<int>").alias("px"))
    return d.mapInArrow(_palettes(id_col, most), f"`{id_col}` {kind}, palette array<int>, indices array<int>, cost long")


def _by_frequency(id_col: str):
    def run(batches):
        for batch in batches:
            lists = batch.column("px")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, row))  # stable: the first of a run is the first place
            r, v = row[order], values[order]
            begin = np.flatnonzero(np.concatenate([np.ones(min(len(r), 1), bool), (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
            count = np.diff(np.append(begin, len(r)))
            first = np.lexsort((order[begin], -count, r[begin]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(r[begin], minlength=len(sizes)))]).astype(np.int32)
            mask = lists.is_null() if lists.null_count else None
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(ends), pa.array(v[begin][first], pa.int32()), mask=mask)], names=[id_col, "colours"])

    return run


def frequency_order(regions: DataFrame, id_col: str = "block_id") -> DataFrame:
    """id, colours: the distinct samples, the most frequent first, then by first place; samples are sorted, not met pair by pair."""
    d = regions.select(id_col, F.col("px").cast("array<int>").alias("px"))
    return d.mapInArrow(_by_frequency(id_col), f"`{id_col}` {regions.schema[id_col].dataType.simpleString()}, colours array<int>")
