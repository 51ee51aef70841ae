"""Periodic run detection: maximal repetitions of words in each text, and texts with the repetitions collapsed.

A run is a stretch of words with smallest period q, of at least max(24, 3 * q)
words, that no neighbouring word extends with that period. Runs are found by
uniting suffixes in order of falling LCP, Kruskal's way:

1. Words get ranks by their next 1, 2, 4, ... words (prefix doubling), all
   documents of a slice at once; a rank that is one word's alone is final. The
   last ranks are the suffix order, all of them together give LCPs.
2. Where a run starts, s, and one period on, s + q, at least 16 words agree and
   the words before differ. So only classes of 16 words with two different words
   before them are kept, whole; there are few.
3. The suffixes of a class start alone, as ordered sets of positions. Neighbours in
   suffix order are united by falling LCP, the smaller set into the larger. Two
   positions that become neighbours in a set, at distance d <= LCP, with different
   words before them, are the start of the run of period d. d is the smallest period:
   with a smaller one, a position between the two would have been united earlier.

Documents are independent, so this is one pass without a shuffle. A task holds a
slice of texts, or one text that is longer.

Nulls: a null text has no words and no runs. Without doc_id no word is rewritten.
Rows that share a doc_id are each judged by themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lists_of, slices

SHORTEST, TIMES = 24, 3
#: Words that agree at the start of a run and one period on: 24 - q for periods to 8, 2 * q beyond.
AGREE = 16

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def rewritten(doc_ids: list[int | None], offsets: np.ndarray) -> np.ndarray:
    """Of each word, the place of the word that stands there in the rewritten text.

    With h = crc32 of the decimal id, every text with h % 10 = 0 repeats p words from word a to its end.
    """
    out = np.arange(offsets[-1])
    for d, low, high in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = high - low
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[low + a : high] = low + a + np.arange(n - a) % p
    return out


class Suffixes:
    """Ranks of the suffixes of many texts by their first 1, 2, 4, ... words; equal ranks mean equal words of one text."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = len(codes)
        end = np.repeat(offsets[1:], np.diff(offsets))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.levels = [self._named(doc * (int(codes.max(initial=0)) + 1) + codes)]
        live, k = np.arange(n), 1
        while len(live):
            rank = self.levels[-1]
            order = np.argsort(rank[live], kind="stable")
            value = rank[live][order]
            first = np.concatenate([[True], value[1:] != value[:-1]])
            size = np.diff(np.append(np.flatnonzero(first), len(value)))
            live = live[order][np.repeat(size > 1, size)]
            if not len(live):
                break
            on = live + k
            second = np.where(on < end[live], rank[np.minimum(on, n - 1)], -1)
            order = np.lexsort((second, rank[live]))
            a, b = rank[live][order], second[order]
            group = np.concatenate([[True], a[1:] != a[:-1]])
            new = group | np.concatenate([[True], b[1:] != b[:-1]])
            at = np.arange(len(a))
            # a group keeps the places from its old rank on
            up = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            following = rank.copy()
            following[live[order]] = a + up
            self.levels.append(following)
            k *= 2

    @staticmethod
    def _named(values: np.ndarray) -> np.ndarray:
        """The number of smaller values, of each value."""
        order = np.argsort(values, kind="stable")
        s = values[order]
        new = np.concatenate([np.ones(min(len(s), 1), bool), s[1:] != s[:-1]])
        out = np.empty(len(s), np.int32)
        out[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        return out

    def lcp(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words two suffixes of one text share; x != y."""
        n, out = len(self.levels[0]), np.zeros(len(x), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            a, b = x + out, y + out
            inside = np.maximum(a, b) < n
            rank = self.levels[j]
            out += (inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])).astype(np.int64) << j
        return out


def seeds(positions: list[int], lcps: list[int]) -> list[tuple[int, int, int]]:
    """(x, y, LCP) of all that become neighbours when suffixes, given in suffix order with the LCP to the next, are united by falling LCP."""
    owner = list(range(len(positions)))
    sets: list[list[int]] = [[p] for p in positions]
    out = []

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for e in sorted(range(len(lcps)), key=lcps.__getitem__, reverse=True):
        shared = lcps[e]
        a, b = root(e), root(e + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        fresh = set(small)
        for p in small:
            i = bisect_left(large, p)
            large.insert(i, p)
        for p in small:
            i = bisect_left(large, p)
            if i and large[i - 1] not in fresh:
                out.append((large[i - 1], p, shared))
            if i + 1 < len(large) and large[i + 1] not in fresh:
                out.append((p, large[i + 1], shared))
        owner[b], sets[b] = a, []
    return out


def runs_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The runs (first word, length, period) of all texts, as rows in order of first word and period; texts are ranges of codes."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < SHORTEST:
        return none
    use = _repeating(codes, offsets)
    if not len(use):
        return none
    # only texts with sixteen words that repeat are ranked
    lengths = np.diff(offsets)[use]
    sub = np.concatenate([[0], np.cumsum(lengths)])
    source = np.repeat(offsets[:-1][use] - sub[:-1], lengths) + np.arange(sub[-1])
    c = codes[source]
    s = Suffixes(c, sub)
    sixteen = s.levels[min(4, len(s.levels) - 1)]
    before = np.concatenate([[-1], c[:-1]])
    before[sub[:-1]] = -1
    order = np.argsort(sixteen, kind="stable")
    value, left = sixteen[order], before[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(first, len(value)))
    varied = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    kept = order[np.repeat(varied & (size > 1), size)]
    if not len(kept):
        return none
    kept = kept[np.argsort(s.levels[-1][kept], kind="stable")]
    group = sixteen[kept]
    shared = s.lcp(kept[:-1], kept[1:])
    cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
    rows = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kept)], strict=True):
        rows += seeds(kept[a:b].tolist(), shared[a : b - 1].tolist())
    if not rows:
        return none
    x, y, agree = np.array(rows, np.int64).T
    d = y - x
    good = (d <= agree) & (before[x] != before[y]) & (d + agree >= np.maximum(SHORTEST, TIMES * d))
    x, d, agree = x[good], d[good], agree[good]
    out = np.stack([source[x], d + agree, d], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _repeating(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts in which sixteen words come twice, by hash (a text too many is no harm)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in (1, 2, 4, 8):
        h = h[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + (h[k:] ^ (h[k:] >> np.uint64(31)))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(h)]
    inside = np.arange(len(h)) + AGREE <= offsets[1:][doc]
    h, doc = (h + doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))[inside], doc[inside]
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    return np.unique(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length / period; of equals the first, then that of the smallest period."""
    out = runs[0]
    for r in runs[1:]:
        if r[1] * out[2] > out[1] * r[2]:
            out = r
    return out


def _judge(rewrite: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                codes = w.codes[rewritten(ids, w.offsets)] if rewrite else w.codes
                runs = runs_of(codes, w.offsets)
                steps = np.zeros(len(codes) + 1, np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
                stay = np.cumsum(steps[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(stay)])[w.offsets]
                words = w.distinct.cast(pa.large_string()).take(pa.array(codes[stay]))
                texts = pc.binary_join(lists_of(words, kept), pa.scalar(" ", pa.large_string()))
                doc = np.searchsorted(w.offsets, runs[:, 0], side="right") - 1
                runs[:, 0] -= w.offsets[doc]
                cut = np.searchsorted(doc, np.arange(len(ids) + 1))
                rows = []
                for i, d in enumerate(ids):
                    mine = [tuple(r) for r in runs[cut[i] : cut[i + 1]].tolist()]
                    told = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in mine).encode()).hexdigest()
                    a, n, q = _best(mine) if mine else (None, None, None)
                    rows.append((d, len(mine), a, n, q, 1000 * n // q if mine else None, told, hashlib.sha256(texts[i].as_buffer()).hexdigest()))
                c = list(zip(*rows, strict=True)) or [[]] * 8
                types = [pa.int64()] * 6 + [pa.string()] * 2
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=names)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """One row per document: its number of runs, the one of most repetitions, digests of all runs and of the collapsed text.

    A word is dropped if a run contains it after that run's first period. With rewrite, texts are first rewritten as `rewritten` says.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_judge(rewrite), SCHEMA)


def _collapse(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            runs = runs_of(w.codes, w.offsets)
            steps = np.zeros(len(w.codes) + 1, np.int64)
            np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
            np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
            stay = np.cumsum(steps[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stay)])[w.offsets]
            words = w.distinct.cast(pa.large_string()).take(pa.array(w.codes[stay]))
            texts = pc.binary_join(lists_of(words, kept), pa.scalar(" ", pa.large_string())).cast(pa.string())
            touched = np.add.reduceat(np.append(~stay, False), w.offsets[:-1]) > 0 if len(w.codes) else np.zeros(part.num_rows, bool)
            touched &= w.counts > 0
            out = pc.if_else(pa.array(touched), texts, part.column("text").cast(pa.string()))
            yield part.set_column(part.schema.get_field_index("text"), "text", out)


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every run in its texts cut to its first period; texts without runs stay as they are, others are joined by single spaces."""
    plain = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    out = plain.mapInArrow(_collapse, plain.schema)
    return out.withColumnRenamed("text", text_col) if text_col != "text" else out
