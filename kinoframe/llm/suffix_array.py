"""Suffix-array dedup: bytes that a 200-byte string covers which also starts anywhere else.

Sorting the suffixes of a whole corpus needs every suffix and all of its text. Only
suffixes that can share 200 bytes with another are sorted here, one bucket at a
time, and no comparison goes beyond a bounded context:

1. A text that another document repeats whole goes (if it has 200 bytes); one row of each
   such group stands for it below.
2. The anchor of a 200-byte string is the first of its 72-byte grams with the least hash. Equal
   strings have equal anchors at equal places, so only anchors that occur twice matter;
   about one byte in 65 begins an anchor, and most occur once.
3. Which strings have their anchor at x is decided by the context of x, the 128 bytes before it and
   the 200 from it on. An occurrence whose whole context comes twice (128 bits) repeats
   all of its strings: nothing is left to sort.
4. The other contexts of an anchor are its bucket. The bytes of its distinct contexts meet in one
   task, which sorts the suffixes that begin strings by difference cover: positions whose number
   modulo 13 is 0, 1, 3 or 9 are ranked first, by doubling; suffixes are sorted by 13 bytes, and ties
   are resolved by the ranks at the shift that brings both to ranked positions. Neighbours that
   agree in 200 bytes, compared byte for byte, are repeated.
5. A bucket of more than BUCKET contexts is dealt out in blocks. Strings that are alone in their
   block, and one of each that is not, then meet by 128-bit hashes over all blocks.

Memory of a task: a slice of texts (or one longer text), and some thousand contexts of 328 bytes.

Nulls: a null text is empty. Rows are told apart by a number of their own, so null, shared and
repeated ids are judged row by row. Texts shorter than 200 bytes stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, durable, mix, ragged, release, slices
from .groups import changes, whole_groups

WINDOW, GRAM = 200, 72
#: Grams of a window but one: the bytes of a context before the anchor.
LEFT = WINDOW - GRAM
CONTEXT = LEFT + WINDOW
#: Bytes whose grams are hashed at once, contexts that are sorted at once, contexts of a block of a bucket on the average:
#: 8192 are 2.7 MB of text and half a million suffixes, some 100 MB of arrays in a task.
PIECE, CONTEXTS, BUCKET = 1 << 18, 4096, 8192
#: A perfect difference cover: any two places have one shift below 13 that brings both into it.
PERIOD, COVER = 13, (0, 1, 3, 9)

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [mix(np.arange(256, dtype=np.uint64), 101 + k) for k in (0, 1)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    if k not in _POWERS or len(_POWERS[k][0]) < n:
        size = max(n, PIECE + 4 * CONTEXT)
        base = _BASES[k]
        pair = [np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for p in pair:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        _POWERS[k] = tuple(pair)
    return _POWERS[k]


class Sums:
    """Hashes of any stretches of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray, k: int):
        power, self.inverse = _powers(k, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[k][data] * power[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of all stretches of one length."""
        n = max(len(self.sums) - length, 0)
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` values, from running minima of blocks from both ends."""
    n = len(x) - span + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // span)
    padded = np.full(blocks * span, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1 : span - 1 + n])


def least_grams(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, first, last): the first least of windows of `span` values, and the windows of which it is that."""
    m = sliding_min(g, span)
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    last = np.append(first[1:] - 1, len(m) - 1)
    x = first + span - 1
    # a value that falls came in at the end; one that rises is looked for
    look = np.concatenate([[0], np.flatnonzero(m[first[1:]] > m[first[:-1]]) + 1])
    x[look] = first[look] + np.argmax(g[first[look][:, None] + np.arange(span)] == m[first[look]][:, None], axis=1)
    tied = np.flatnonzero(last > x)  # the value comes again before it is gone: repeats within a window
    more = []
    for t in tied.tolist():
        a, b = int(first[t]), int(last[t])
        at = a + np.flatnonzero(g[a : b + span] == m[a])
        low = np.concatenate([[a], at[:-1] + 1])
        use = low <= b
        more.append(np.stack([at[use], low[use], np.minimum(at[use], b)]))
    if more:
        rest = last <= x
        x, first, last = np.concatenate([np.stack([x[rest], first[rest], last[rest]]), *more], axis=1)
    return x, first, last


class Anchors:
    """Anchors of the texts that begin at `offsets` in `data`: places, hashes, the nearest and farthest string before each, contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, contexts: bool = True):
        parts = []
        for low in range(0, len(data), PIECE):
            parts.append(self._piece(data, offsets, low, min(low + PIECE, len(data)), contexts))
        self.x, self.doc, self.anchor, self.near, self.far, self.c1, self.c2 = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 7

    @staticmethod
    def _piece(data: np.ndarray, offsets: np.ndarray, low: int, high: int, contexts: bool):
        begin, end = max(low - LEFT, 0), min(high + CONTEXT, len(data))
        sums = Sums(data[begin:end], 0)
        g = mix(sums.every(GRAM), 7)
        x, first, last = least_grams(g, LEFT + 1)
        doc = np.searchsorted(offsets, x + begin, side="right") - 1
        start, stop = offsets[doc] - begin, offsets[doc + 1] - begin
        first, last = np.maximum(first, start), np.minimum(last, stop - WINDOW)
        use = (first <= last) & (x >= low - begin) & (x < high - begin)
        x, first, last, doc, start, stop = (v[use] for v in (x, first, last, doc, start, stop))
        c1 = c2 = x[:0]
        if contexts:
            a, b = np.maximum(x - LEFT, np.maximum(start, 0)), np.minimum(x + WINDOW, np.minimum(stop, end - begin))
            shape = ((x - a) * 1024 + (b - x)).astype(np.uint64)
            other = Sums(data[begin:end], 1)
            c1, c2 = (mix(s.of(a, b) ^ mix(shape, 13), 17 + k).view(np.int64) for k, s in enumerate((sums, other)))
        return x + begin, doc, g[x].view(np.int64), x - last, x - first, c1, c2

    def take(self, rows: np.ndarray) -> None:
        for name, v in vars(self).items():
            setattr(self, name, v[rows] if len(v) else v)


def _data(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, one after the other, and where each begins."""
    text = part.column("text").cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _within(values: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which values are in the list of their document."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    pairs = np.concatenate([np.stack([owner, flat, np.zeros_like(flat)], axis=1), np.stack([doc, values, np.arange(1, len(doc) + 1)], axis=1)])
    order = np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))
    s = pairs[order]
    new = np.concatenate([[True], (s[1:, :2] != s[:-1, :2]).any(axis=1)]) if len(s) else np.zeros(0, bool)
    listed = s[np.flatnonzero(new)[np.cumsum(new) - 1], 2] == 0 if len(s) else new
    out = np.zeros(len(doc), bool)
    out[s[listed & (s[:, 2] > 0), 2] - 1] = True
    return out


def _survey(batches):
    """Of each row: bytes, digest, its anchors; those that it has more than once stand twice."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = _data(part)
            a = Anchors(data, offsets, contexts=False)
            order = np.lexsort((a.anchor, a.doc))
            doc, anchor = a.doc[order], a.anchor[order]
            same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1])])[: len(doc)]
            third = same & np.concatenate([[False], same[:-1]])[: len(doc)]
            doc, anchor = doc[~third], anchor[~third]
            counts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
            digests = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(ROW), part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(anchor))],
                names=[ROW, "doc_id", "n_bytes", "sha", "anchors"],
            )


def _contexts(batches):
    """Of each row, the contexts of its shared anchors, and how often each comes in it."""
    for batch in batches:
        for part in slices(batch):
            a = Anchors(*_data(part))
            a.take(np.flatnonzero(_within(a.anchor, a.doc, part.column("anchors"))))
            order = np.lexsort((a.c2, a.c1, a.doc))
            a.take(order)
            new = np.flatnonzero(np.concatenate([np.ones(min(len(a.x), 1), bool), (a.doc[1:] != a.doc[:-1]) | (a.c1[1:] != a.c1[:-1]) | (a.c2[1:] != a.c2[:-1])]))
            n = np.diff(np.append(new, len(a.x)))
            rows = part.column(ROW).to_numpy()[a.doc[new]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rows, a.anchor[new], a.c1[new], a.c2[new], n)], names=[ROW, "anchor", "c1", "c2", "n"])


def _fetch(batches):
    """The bytes of wanted contexts, each from one place of its row."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = _data(part)
            a = Anchors(data, offsets)
            a.take(np.flatnonzero(_within(a.c1, a.doc, part.column("wanted"))))
            a.take(np.lexsort((a.c2, a.c1, a.doc)))
            a.take(np.flatnonzero(np.concatenate([np.ones(min(len(a.x), 1), bool), (a.doc[1:] != a.doc[:-1]) | (a.c1[1:] != a.c1[:-1]) | (a.c2[1:] != a.c2[:-1])])))
            rows = part.column(ROW).to_numpy()[a.doc]
            for i in range(0, len(a.x), CONTEXTS):
                k = slice(i, i + CONTEXTS)
                at = a.x[k][:, None] + np.arange(-LEFT, WINDOW)
                inside = (at >= offsets[a.doc[k]][:, None]) & (at < offsets[a.doc[k] + 1][:, None])
                text = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
                ends = pa.array((np.arange(len(text) + 1) * CONTEXT).astype(np.int32))
                context = pa.Array.from_buffers(pa.binary(), len(text), [None, ends.buffers()[1], pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.array(v[k]) for v in (rows, a.c1, a.c2)), *(pa.array(v[k].astype(np.int32)) for v in (a.near, a.far)), context], names=[ROW, "c1", "c2", "near", "far", "context"])


def _shifts() -> np.ndarray:
    """For two places modulo PERIOD, the least shift that brings both into the cover."""
    return np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


SHIFTS = _shifts()


class CoverOrder:
    """Suffixes of some bytes by difference cover: the order of chosen ones by their first WINDOW bytes, and which neighbours share those."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        padded = np.concatenate([data, np.zeros(2 * WINDOW + 4 * PERIOD, np.uint8)])
        #: eight bytes from each place on, as a number in byte order
        self.words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
        self.at = np.flatnonzero(np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
        #: ranks of all places; only those of the cover are set
        self.rank = np.zeros(n + 2 * WINDOW + 4 * PERIOD, np.int64)
        order = np.lexsort((self.words[self.at + 8], self.words[self.at]))
        self._name(order, self.words[self.at], self.words[self.at + 8])
        known, step = 16, PERIOD
        while known < WINDOW:
            pair = self.rank[self.at] * (len(self.at) + 1) + self.rank[np.minimum(self.at + step, len(self.rank) - 1)]
            self._name(np.argsort(pair, kind="stable"), pair)
            known, step = known + step, 2 * step

    def _name(self, order: np.ndarray, *keys: np.ndarray) -> None:
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        self.rank[self.at[order]] = np.cumsum(new)

    def sort(self, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, same): the order of the suffixes of each group, and whether each shares WINDOW bytes with the one before it there."""
        w1, w2 = self.words[starts], self.words[starts + PERIOD - 8]
        order = np.lexsort((w2, w1, group))
        starts, group, w1, w2 = starts[order], group[order], w1[order], w2[order]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        tie = np.cumsum(new)
        size = np.bincount(tie)[tie]
        place = np.zeros(len(order), np.int64)
        many = np.flatnonzero(size > 1)
        # the place among ties: how many of each class of places modulo PERIOD are smaller, by ranks at the shift of both classes
        kinds = [many[starts[many] % PERIOD == r] for r in range(PERIOD)]
        top = len(self.at) + 2
        for b, other in enumerate(kinds):
            low = tie[other] * top
            for d in set(SHIFTS[:, b].tolist()):
                known = np.sort(low + self.rank[starts[other] + d])
                mine = np.concatenate([kinds[a] for a in range(PERIOD) if SHIFTS[a, b] == d])
                key = tie[mine] * top
                place[mine] += np.searchsorted(known, key + self.rank[starts[mine] + d]) - np.searchsorted(known, key)
        within = np.lexsort((place, tie))
        order, starts, tie = order[within], starts[within], tie[within]
        same = np.zeros(len(order), bool)
        live = np.flatnonzero(tie[1:] == tie[:-1]) + 1
        for k in range(0, WINDOW, 8):
            live = live[self.words[starts[live] + k] == self.words[starts[live - 1] + k]]
        same[live] = True
        return order, same


def _sort_buckets(batches):
    """Of each context, the places before its anchor at which a repeated string begins (bits); of blocks, the strings to be met elsewhere."""
    for table in whole_groups(batches, ["anchor", "block"], CONTEXTS):
        m = table.num_rows
        context = table.column("context").combine_chunks()
        ends = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + m + 1]
        data = np.frombuffer(context.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        near, far, blocks = (table.column(c).to_numpy().astype(np.int64) for c in ("near", "far", "blocks"))
        group = np.zeros(m, np.int64)
        group[changes(table, ["anchor", "block"])] = 1
        group = np.cumsum(group)
        counts = far - near + 1
        before = ragged(near, counts)
        owner = np.repeat(np.arange(m), counts)
        starts = owner * CONTEXT + LEFT - before
        order, same = CoverOrder(data).sort(starts, group[owner])
        number = np.cumsum(~same)
        twice = np.bincount(number)[number] > 1
        bits = np.zeros((m, LEFT + 1), bool)
        bits[owner[order[twice]], before[order[twice]]] = True
        met = order[~same & (blocks[owner[order]] > 1)]  # one of each string of a block
        met = met[np.argsort(owner[met], kind="stable")]
        names = [mix((Sums(data, k).of(starts[met], starts[met] + WINDOW)), 19 + k).view(np.int64) for k in (0, 1)] if len(met) else [met, met]
        cut = np.concatenate([[0], np.cumsum(np.bincount(owner[met], minlength=m))]).astype(np.int32)
        strings = pa.StructArray.from_arrays([pa.array(before[met].astype(np.int32)), *(pa.array(v) for v in names)], names=["l", "w1", "w2"])
        packed = np.packbits(bits, axis=1)
        mask = pa.array([r.tobytes() for r in packed], pa.binary())
        out = [table.column(c).combine_chunks() for c in ("c1", "c2")]
        yield pa.RecordBatch.from_arrays([*out, mask, pa.ListArray.from_arrays(pa.array(cut), strings)], names=["c1", "c2", "mask", "strings"])


def _remove(batches):
    for batch in batches:
        for part in slices(batch):
            data, offsets = _data(part)
            a = Anchors(data, offsets)
            told = part.column("told")
            flat, ends = told.flatten(), told.offsets.to_numpy()
            owner = np.repeat(np.arange(len(told)), np.diff(ends))
            c1 = flat.field("c1").to_numpy(zero_copy_only=False)
            a.take(np.flatnonzero(_within(a.c1, a.doc, pa.ListArray.from_arrays(pa.array(ends - ends[0]), flat.field("c1")))))
            # of each occurrence, its entry: the last entry up to it in the order of (row, c1)
            key = np.lexsort((np.concatenate([np.zeros(len(c1), np.int64), np.ones(len(a.x), np.int64)]), np.concatenate([c1, a.c1]), np.concatenate([owner, a.doc])))
            entry = np.empty(len(key), np.int64)
            entry[key] = np.maximum.accumulate(np.where(key < len(c1), np.arange(len(key)), 0))
            entry = key[entry[len(c1) :]] if len(key) else key
            whole = flat.field("mask").is_null().to_numpy(zero_copy_only=False)[entry] if len(entry) else np.zeros(0, bool)
            steps = np.zeros(len(data) + 1, np.int32)
            np.add.at(steps, a.x[whole] - a.far[whole], 1)
            np.add.at(steps, a.x[whole] - a.near[whole] + WINDOW, -1)
            single = np.flatnonzero(~whole)
            masks, more = flat.field("mask"), flat.field("more")
            for i in single.tolist():
                e = int(entry[i])
                at = np.flatnonzero(np.unpackbits(np.frombuffer(masks[e].as_py(), np.uint8))[: LEFT + 1])
                if more[e].is_valid:
                    at = np.unique(np.concatenate([at, np.array(more[e].as_py(), np.int64)]))
                begin = a.x[i] - at
                steps[begin] += 1
                steps[begin + WINDOW] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            rows = []
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                mine = gone[low:high]
                n = int(mine.sum())
                rows.append((n, int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()), hashlib.sha256(data[low:high][~mine]).hexdigest() if n else None))
            c = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], names=[ROW, "cut", "spans", "cut_sha"])


def suffix_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256. bucket: contexts of a block of a large bucket."""
    source = durable(docs.select(F.monotonically_increasing_id().alias(ROW), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "suffix-rows")
    survey = durable(source.mapInArrow(_survey, f"{ROW} long, doc_id long, n_bytes long, sha string, anchors array<long>"), "suffix-survey")
    copies = survey.where(F.col("n_bytes") >= WINDOW).groupBy("sha").agg(F.min(ROW).alias(ROW), F.count("*").alias("copies")).drop("sha")
    firsts = survey.join(copies, ROW, "left")  # a row without a count repeats another, or is short

    places = firsts.where("copies is not null").select(ROW, F.explode("anchors").alias("anchor"))
    shared = places.groupBy("anchor").count().where("count > 1").select("anchor")
    work = places.join(shared, "anchor").groupBy(ROW).agg(F.collect_set("anchor").alias("anchors"))
    opened = durable(source.select(ROW, "text").join(work, ROW), "suffix-opened")
    met = durable(opened.mapInArrow(_contexts, f"{ROW} long, anchor long, c1 long, c2 long, n long"), "suffix-contexts")
    classes = durable(met.groupBy("anchor", "c1", "c2").agg(F.sum("n").alias("n"), F.min(ROW).alias(ROW)), "suffix-classes")
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    blocks = F.ceil(F.col("contexts") / bucket).cast("int")
    todo = classes.join(sizes.select("anchor", blocks.alias("blocks")), "anchor").withColumn("block", F.pmod("c2", "blocks").cast("int"))
    todo = durable(todo, "suffix-todo")
    wanted = opened.select(ROW, "text").join(todo.groupBy(ROW).agg(F.collect_list("c1").alias("wanted")), ROW)
    fetched = wanted.mapInArrow(_fetch, f"{ROW} long, c1 long, c2 long, near int, far int, context binary")
    fetched = fetched.join(todo, [ROW, "c1", "c2"]).select("anchor", "block", "blocks", "c1", "c2", "near", "far", "context")
    sorted_ = fetched.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    masks = durable(sorted_.mapInArrow(_sort_buckets, "c1 long, c2 long, mask binary, strings array<struct<l: int, w1: long, w2: long>>"), "suffix-masks")
    strings = masks.select("c1", "c2", F.explode("strings").alias("s")).select("c1", "c2", "s.*")
    twice = strings.groupBy("w1", "w2").count().where("count > 1").drop("count")
    more = strings.join(twice, ["w1", "w2"]).groupBy("c1", "c2").agg(F.collect_list("l").alias("more"))
    none = F.lit(None)
    repeated = classes.where("n > 1").select("c1", "c2", none.cast("binary").alias("mask"), none.cast("array<int>").alias("more"))
    single = classes.where("n = 1").select("c1", "c2").join(masks.select("c1", "c2", "mask").join(more, ["c1", "c2"], "left"), ["c1", "c2"])
    verdicts = repeated.union(single)
    told = met.join(verdicts, ["c1", "c2"]).groupBy(ROW).agg(F.collect_list(F.struct("c1", "mask", "more")).alias("told"))
    cut = durable(opened.select(ROW, "text").join(told, ROW).mapInArrow(_remove, f"{ROW} long, cut long, spans long, cut_sha string"), "suffix-cut")
    whole = F.coalesce(F.col("copies") != 1, F.col("n_bytes") >= WINDOW)
    zero = F.lit(0).cast("long")
    out = firsts.join(cut, ROW, "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("cut", zero)).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", zero)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
    out = durable(out, "suffix-verdicts")
    for table in (source, survey, opened, met, classes, todo, masks, cut):
        release(table)
    return out
