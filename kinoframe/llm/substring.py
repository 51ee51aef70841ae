"""Substring dedup over a log-structured index of window fingerprints.

Words covered by a 50-word window that also starts in a document of a smaller
id go. Documents come in batches of rising ids. The index is a log of sorted
immutable runs of (kind, h1, h2) -> smallest document: whole texts, anchors and
windows. A batch merge-joins the runs:

1. A text seen before is a copy: all its words go (if it has 50).
2. The anchor of a window is the least hash of its 25-word runs. Equal windows
   have equal anchors, so only windows whose anchor a second document shares can
   repeat; about one word in 13 is an anchor, and most anchors are of one document.
3. Windows at shared anchors get 128 bits over all their words. An anchor of the
   index that a batch shares for the first time has its one document opened and
   its windows added; from then on the index holds all windows of that anchor.
4. A window whose hash a smaller document has is a candidate. The smallest such
   document cuts out the passages that candidates name, each passage once, and the
   words of a candidate are marked only if they are those of the passage. (If two
   texts shared a hash, words could stay that had to go; none go that had to stay.)

The batch's own keys are appended as a new run; runs are compacted when there
are too many, keeping the smallest document of each key. `save` and `open` keep
an index between jobs.

Nulls: a null text has no words. A row without doc_id is compared with nothing.
Rows are judged by (doc_id, text): rows that share an id and differ in text are compared
with the documents of smaller ids, not with one another, and those alike in both get the same verdict.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct, durable, mix, release, slices

WINDOW, GRAM = 50, 25
BATCHES, MOST_RUNS = 3, 2
TEXT, ANCHOR, PIECE = 2, 0, 1
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolling(h: np.ndarray, span: int, base: np.uint64) -> np.ndarray:
    """At each word, a polynomial hash of `span` words from there on, joined from halves; len(h) >= span."""
    if span == 1:
        return h
    half = span // 2
    block = rolling(h, half, base)
    out = block[: len(block) - half] * _power(base, half) + block[half:]
    return out if span % 2 == 0 else out[: len(out) - 1] * base + h[span - 1 :]


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        x = np.minimum(x[: max(len(x) - width, 0)], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: max(len(x) - rest, 0)], x[rest:]) if rest else x


class Windows:
    """Anchors and hashes of the 50-word windows of a slice of texts."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        self.h = self.words.hashes()
        grams = mix(rolling(self.h[:, 0], GRAM, _B1), 7) if len(self.h) >= GRAM else np.zeros(0, np.uint64)
        self.anchor = sliding_min(grams, WINDOW - GRAM + 1).view(np.int64) if len(self.h) >= WINDOW else np.zeros(0, np.int64)
        #: of each text: its first window and how many it has
        self.first, self.count = self.words.offsets[:-1], np.maximum(self.words.counts - WINDOW + 1, 0)

    def hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, two independent hashes of so many bits."""
        if len(self.h) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple((mix(rolling(self.h[:, k], WINDOW, b), 11 + k) >> np.uint64(64 - bits)).view(np.int64) for k, b in ((0, _B2), (1, _B1)))


def _hex(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _survey(batches):
    for batch in batches:
        for part in slices(batch):
            w = Windows(part.column("text"))
            names, rows = np.array(w.words.distinct.to_pylist(), dtype=object)[w.words.codes], []
            for a, n, first, count in zip(w.words.offsets, w.words.counts, w.first, w.count, strict=False):
                text = " ".join(names[a : a + n]).encode()
                digest = hashlib.sha256(text)
                s = np.frombuffer(digest.digest(), dtype="<i8")
                rows.append((int(n), int(s[0]), int(s[1]), digest.hexdigest(), distinct(w.anchor[first : first + count])))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("u"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.list_(pa.int64()))],
                names=["doc_id", "u", "n_words", "s1", "s2", "sha", "anchors"],
            )


def _open_windows(bits: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column("text"))
                h1, h2 = w.hashes(bits)
                wanted = part.column("anchors").to_pylist()
                at, row, start = [], [], []
                for i, (first, count, open_anchors) in enumerate(zip(w.first, w.count, wanted, strict=True)):
                    hit = np.flatnonzero(np.isin(w.anchor[first : first + count], np.array(open_anchors, np.int64)))
                    at.append(first + hit)
                    start.append(hit)
                    row.append(np.full(len(hit), i, np.int64))
                at, row, start = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at, row, start))
                names = [part.column(c).take(pa.array(row)) for c in ("doc_id", "u")]
                yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), *names, pa.array(start.astype(np.int32))], names=["h1", "h2", "doc_id", "u", "start"])

    return run


def _passages(bits: int):
    """Of each document, the passages that its wanted windows cover: where they begin, the hashes of their windows, their words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Windows(part.column("text"))
                h1, h2 = w.hashes(bits)
                names, rows = np.array(w.words.distinct.to_pylist(), dtype=object)[w.words.codes], []
                for d, u, first, count, wanted in zip(part.column("doc_id").to_pylist(), part.column("u").to_pylist(), w.first, w.count, part.column("wanted").to_pylist(), strict=True):
                    mine = h1[first : first + count]
                    value, where = np.unique(mine, return_index=True)
                    starts = np.sort(where[np.isin(value, np.array(wanted, np.int64))])
                    for piece in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                        if len(piece):
                            low, high = first + piece[0], first + piece[-1] + 1
                            rows.append((d, u, int(piece[0]), h1[low:high].tolist(), h2[low:high].tolist(), " ".join(names[low : high + WINDOW - 1])))
                c = list(zip(*rows, strict=True)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["owner", "ou", "at", "p1", "p2", "passage"])

    return run


def verified(words: np.ndarray, passage: np.ndarray, starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which windows of `words`, at starts, are word for word those of `passage` at offs."""
    good = np.zeros(len(starts), bool)
    order = np.argsort(starts - offs, kind="stable")
    shift = (starts - offs)[order]
    for group in np.split(order, np.flatnonzero(np.diff(shift)) + 1):
        if len(group):
            d, low, high = starts[group[0]] - offs[group[0]], offs[group].min(), offs[group].max() + WINDOW
            wrong = np.concatenate([[0], np.cumsum(words[d + low : d + high] != passage[low:high])])
            good[group] = wrong[offs[group] - low + WINDOW] == wrong[offs[group] - low]
    return good


def _remove(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            names = np.array(w.distinct.to_pylist(), dtype=object)[w.codes]
            removed, digest = [], []
            for a, n, passages in zip(w.offsets, w.counts, part.column("passages").to_pylist(), strict=False):
                mine, steps = names[a : a + n], np.zeros(n + 1, np.int64)
                for p in passages:
                    places = np.array(p["places"], np.int64)
                    starts, offs = places >> 32, places & 0xFFFFFFFF
                    starts = starts[verified(mine, np.array(p["passage"].split(" "), dtype=object), starts, offs)]
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, starts + WINDOW, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                digest.append(_hex(mine[~gone].tolist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("u"), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "u", "n_removed", "sha"])


class FingerprintIndex:
    """A log of sorted runs (kind, h1, h2, first, open): the smallest document of each key."""

    SCHEMA = "kind int, h1 long, h2 long, first long, open boolean"

    def __init__(self, spark, hash_bits: int = 64):
        self.spark, self.bits, self.runs = spark, hash_bits, []

    @classmethod
    def open(cls, spark, path: str, hash_bits: int = 64) -> FingerprintIndex:
        """The index that `save` wrote to path, as one run."""
        index = cls(spark, hash_bits)
        index.runs = [durable(spark.read.schema(cls.SCHEMA).parquet(path), "run")]
        return index

    def save(self, path: str) -> None:
        """Write the index, compacted, to a folder that does not exist yet."""
        self._merged().write.parquet(path)

    def _merged(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA)
        for r in self.runs:
            out = out.union(r)
        return out.groupBy("kind", "h1", "h2").agg(F.min("first").alias("first"), F.max("open").alias("open")).sortWithinPartitions("kind", "h1", "h2")

    def lookup(self, kind: int) -> DataFrame:
        runs = [r.where(F.col("kind") == kind) for r in self.runs] or [self.spark.createDataFrame([], self.SCHEMA)]
        out = runs[0]
        for r in runs[1:]:
            out = out.union(r)
        out = out.groupBy("h1", "h2").agg(F.min("first").alias("seen"), F.max("open").alias("open")) if len(runs) > 1 else out.withColumnRenamed("first", "seen")
        return out.select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "seen", "open")

    def append(self, keys: DataFrame) -> None:
        """Add a run; when there are too many, merge all into one."""
        self.runs.append(durable(keys.sortWithinPartitions("kind", "h1", "h2"), "run"))
        if len(self.runs) > MOST_RUNS:
            merged = durable(self._merged(), "run")
            for r in self.runs:
                release(r)
            self.runs = [merged]

    def add_batch(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Verdicts on a batch (doc_id, text), and its keys into the index; earlier: the documents of the batches before, whose ids are smaller."""
        batch = batch.select("doc_id", "text", F.xxhash64("text").alias("u"))
        earlier = None if earlier is None else earlier.select("doc_id", "text", F.xxhash64("text").alias("u"))
        known = batch.withColumn("new", F.lit(True))
        if earlier is not None:
            known = known.union(earlier.withColumn("new", F.lit(False)))
        a = durable(batch.mapInArrow(_survey, "doc_id long, u long, n_words long, s1 long, s2 long, sha string, anchors array<long>"), "survey")
        named = a.where("doc_id is not null")
        texts = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        old = self.lookup(TEXT)
        owned = durable(texts.join(old, (F.col("s1") == old["i1"]) & (F.col("s2") == old["i2"]), "left").select("s1", "s2", "first", "last", F.least("first", "seen").alias("owner")), "texts")
        copies = owned.where("last > owner").select("s1", "s2", "owner")
        a2 = a.join(copies, ["s1", "s2"], "left")
        copy = F.coalesce(F.col("doc_id") > F.col("owner"), F.lit(False))

        places = a2.where(~copy & F.col("doc_id").isNotNull()).select("doc_id", F.explode("anchors").alias("anchor"))
        places = durable(places, "places")
        per = places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        old = self.lookup(ANCHOR)
        per = durable(per.join(old, F.col("anchor") == old["i1"], "left").select("anchor", "low", "high", "seen", "open"), "anchors")
        shared = per.where("low < high or seen is not null")
        again = shared.where("seen is not null and not open").select(F.col("seen").alias("doc_id"), "anchor")
        work = places.join(shared.select("anchor"), "anchor").select("doc_id", "anchor").union(again).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        opened = durable(known.join(work, "doc_id"), "opened")
        windows = opened.mapInArrow(_open_windows(self.bits), "h1 long, h2 long, doc_id long, u long, start int")
        least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        old = self.lookup(PIECE)
        least = durable(least.join(old, (F.col("h1") == old["i1"]) & (F.col("h2") == old["i2"]), "left").select("h1", "h2", "high", F.least("low", "seen").alias("owner")), "windows")
        hits = windows.join(least.where("high > owner").select("h1", "h2", "owner"), ["h1", "h2"]).where("doc_id > owner")
        hits = durable(hits, "hits")
        found, passages = self._candidates(hits, opened, earlier)
        cut = opened.select("doc_id", "u", "text").join(found, ["doc_id", "u"]).mapInArrow(_remove, "doc_id long, u long, n_removed long, sha string")
        cut = durable(cut.select("doc_id", "u", F.col("n_removed").alias("cut"), F.col("sha").alias("cut_sha")).dropDuplicates(["doc_id", "u"]), "cut")
        keys = (
            owned.select(F.lit(TEXT).alias("kind"), F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("owner").alias("first"), F.lit(True).alias("open"))
            .union(per.select(F.lit(ANCHOR), "anchor", F.lit(0).cast("long"), F.least("low", "seen"), F.expr("low < high or seen is not null")))
            .union(least.select(F.lit(PIECE), "h1", "h2", "owner", F.lit(True)))
        )
        self.append(keys)
        for x in (places, per, opened, least, hits, passages):
            release(x)
        out = a2.join(cut, ["doc_id", "u"], "left")
        whole = copy & (F.col("n_words") >= WINDOW)
        return durable(
            out.select(
                "doc_id",
                "n_words",
                F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
                F.when(whole, F.lit(_hex([]))).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            ),
            "verdicts",
        )


    def _candidates(self, hits: DataFrame, opened: DataFrame, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Of each document, the passages of smaller ones that its windows may repeat, and where: a start and a place in the passage, packed; and the table behind."""
        wanted = hits.groupBy("owner").agg(F.collect_set("h1").alias("wanted")).withColumnRenamed("owner", "doc_id")
        sources = opened.where("new").select("doc_id", "u", "text")
        if earlier is not None:
            sources = sources.union(earlier.select("doc_id", "u", "text"))
        cut = sources.join(wanted, "doc_id").mapInArrow(_passages(self.bits), "owner long, ou long, at int, p1 array<long>, p2 array<long>, passage string")
        table = durable(cut, "passages")
        cut = table.dropDuplicates(["owner", "ou", "at"])
        at = cut.select("owner", "ou", "at", F.posexplode(F.arrays_zip("p1", "p2")).alias("off", "p")).select("owner", "ou", "at", "off", F.col("p.p1").alias("h1"), F.col("p.p2").alias("h2"))
        place = F.shiftleft(F.col("start").cast("long"), 32) + F.col("off")
        met = hits.join(at, ["owner", "h1", "h2"]).groupBy("doc_id", "u", "owner", "ou", "at").agg(F.collect_set(place).alias("places"))
        met = met.join(cut.select("owner", "ou", "at", "passage"), ["owner", "ou", "at"])
        return met.groupBy("doc_id", "u").agg(F.collect_list(F.struct("passage", "places")).alias("passages")), table


def substring_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    edges = sorted(set(source.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index, out, low = FingerprintIndex(docs.sparkSession, hash_bits), None, None
    for high in [*edges, None]:
        batch = source if high is None else source.where(F.col("doc_id") <= int(high))
        if low is not None:
            batch = batch.where((F.col("doc_id") > low) | (F.col("doc_id").isNull() if high is None else F.lit(False)))
        verdicts = index.add_batch(batch, None if low is None else source.where(F.col("doc_id") <= low))
        out = verdicts if out is None else out.union(verdicts)
        low = None if high is None else int(high)
    return out
