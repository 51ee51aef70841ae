"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words (runs of letters,
lower-cased, with a word-start mark). Piece probabilities are learned by EM:
forward-backward counts over a word table of a bounded sample of labelled
documents (SAMPLE_DOCS a language, chosen by hash), summed by Spark. Sums are
scaled as they go, so a word may have any length, and there may be any number
of languages; the model is one number for each language and piece.

Nulls: a null text, or one without letters, is `und` with score 0. Rows with a
null lang teach nothing. With nothing to learn from, all is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, slices

SAMPLE_DOCS, ROUNDS, UNKNOWN = 2000, 2, 1e-9
#: Steps after which sums are scaled: UNKNOWN ** RESCALE is far from underflow.
RESCALE = 16
#: Characters scored at once, and numbers that a group of words may take.
SCORE_CHARS, CELLS = 8_000_000, 4_000_000
_BASE = np.uint64(0x100000001B3)
MARK = "▁"


def letter_text(texts: pa.Array) -> pa.Array:
    """Lower-cased runs of letters with spaces between."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")


def public_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and all(c.isalpha() or c == MARK for c in p)})


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


class Segmenter:
    """Finds all pieces of words and sums over segmentations."""

    def __init__(self, pieces: list[str]):
        self.tables, self.n, self.longest = {}, len(pieces), max(map(len, pieces), default=1)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n, ids in by.items():
            h = self._hash(_codes([pieces[i] for i in ids], n))
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(ids, dtype=np.int32)[order]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = (h ^ codes[:, k].astype(np.uint64)) * _BASE
        return h

    def spans(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the piece at each start (n where there is none), in an array (start, word)."""
        width, out = codes.shape[1], {}
        h = np.zeros((width, len(codes)), np.uint64)
        flat = codes.T.astype(np.uint64)
        for n in range(1, min(self.longest, width) + 1):
            h = (h[: width - n + 1] ^ flat[n - 1 :]) * _BASE
            if n in self.tables:
                keys, ids = self.tables[n]
                at = np.minimum(np.searchsorted(keys, h.reshape(-1)), len(keys) - 1)
                out[n] = np.where(keys[at] == h.reshape(-1), ids[at], self.n).reshape(h.shape)
        return out

    def steps(self, codes: np.ndarray, spans: dict[int, np.ndarray], p: np.ndarray, reverse: bool = False):
        """alpha at each position in turn, (word, language) arrays with the logarithms of their scales; beta from the
        end when reversed. p has a row of zeros for no piece. Only as many positions are held as a piece is long."""
        width = codes.shape[1]
        log = np.zeros((len(codes), p.shape[1]))
        near = [np.ones((len(codes), p.shape[1]))]  # the last positions, latest first
        yield near[0], log
        for j in range(1, width + 1):
            # a character that no piece covers alone
            new = near[0] * UNKNOWN
            for n, ids in spans.items():
                if n <= j:
                    new += near[n - 1] * p[ids[width - j if reverse else j - n]]
            near = [new, *near[: self.longest - 1]]
            if j % RESCALE == 0:
                scale = np.max(near, axis=0)
                near = [x / scale for x in near]
                log = log + np.log(scale)
            yield near[0], log

    def _widths(self, words: list[str], cells: int):
        """Groups of marked words of one length, each with their places; `cells` numbers are held for each word."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            most = max(1, CELLS // (cells + int(n)))
            for a in range(0, len(at), most):
                part = at[a : a + most]
                yield part, _codes([MARK + words[i] for i in part], int(n))

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        for at, codes in self._widths(words, (self.longest + 2) * p.shape[1]):
            for a, log in self.steps(codes, self.spans(codes), p):
                pass
            out[at] = np.log(a) + log
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in `counts` occurrences of the words, for one language (p has one column)."""
        out = np.zeros(self.n + 1)
        longest = max(map(len, words), default=0) + 1
        for at, codes in self._widths(words, 4 * longest):
            spans = self.spans(codes)
            (a, la), (b, lb) = (map(np.array, zip(*((x[:, 0], log[:, 0]) for x, log in self.steps(codes, spans, p, back)), strict=True)) for back in (False, True))
            b, lb = b[::-1], lb[::-1]
            whole = np.log(a[-1]) + la[-1]
            for n, ids in spans.items():
                for start in range(ids.shape[0]):
                    use = a[start] * p[ids[start], 0] * b[start + n] * np.exp(la[start] + lb[start + n] - whole) * counts[at]
                    out += np.bincount(ids[start], use, self.n + 1)
        return out[:-1]


def _word_counts(batches):
    for batch in batches:
        for part in slices(batch):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            w = Words(letter_text(part.column("text")))
            names = w.distinct.to_pylist()
            for lang in sorted(set(langs)):
                n = np.bincount(w.codes[(langs == lang)[w.row]], minlength=len(names))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([names[i] for i in at], pa.string()), pa.array(n[at].astype(np.int64))], names=["lang", "word", "n"])


def train(labelled: DataFrame, vocabulary_path: str) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and piece probabilities (piece, language) from rows (doc_id, text, lang)."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = sorted(((r["count"], r["lang"]) for r in labelled.groupBy("lang").count().collect()), reverse=True)
    langs, pieces = sorted(lang for _, lang in sizes), public_pieces(vocabulary_path)
    if not langs:
        return [], pieces, np.zeros((len(pieces), 0))
    rate = F.create_map(*(F.lit(x) for n, lang in sizes for x in (lang, min(1.0, SAMPLE_DOCS / n))))
    chosen = labelled.withColumn("_rate", F.element_at(rate, F.col("lang"))).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_rate") * (1 << 30))
    table = chosen.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = durable(table, "word-counts")
    p = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(ROUNDS):
        model = labelled.sparkSession.sparkContext.broadcast((langs, pieces, p))  # one number for each language and piece

        def expect(batches):
            langs, pieces, p = model.value
            segmenter = Segmenter(pieces)
            for batch in batches:
                names = np.array(batch.column("lang").to_pylist(), dtype=object)
                place = {lang: k for k, lang in enumerate(langs)}
                for lang in sorted(set(names)):
                    at, k = np.flatnonzero(names == lang), place[lang]
                    if len(at):
                        words = batch.column("word").take(pa.array(at)).to_pylist()
                        use = segmenter.expected(words, batch.column("n").to_numpy()[at].astype(float), np.append(p[:, k], 0.0)[:, None])
                        some = np.flatnonzero(use > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(use[some])], names=["lang", "piece", "n"])

        sums = table.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(p.shape, 0.1)
        counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        p = counts / counts.sum(axis=0)
    return langs, pieces, p


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (posterior with even priors) from rows (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, pieces, p = shared.value
        segmenter, p = Segmenter(pieces), np.vstack([p, np.zeros((1, len(langs)))])
        for batch in batches:
            for part in slices(batch, most=SCORE_CHARS):
                w = Words(letter_text(part.column("text")))
                each = segmenter.log_probability(w.distinct.to_pylist(), p)
                total = np.stack([np.bincount(w.row, each[w.codes, k], part.num_rows) for k in range(len(langs))], axis=1) if langs else np.zeros((part.num_rows, 0))
                known = (w.counts > 0) & bool(langs)
                best = total.argmax(axis=1) if langs else np.zeros(part.num_rows, int)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if langs else np.zeros(part.num_rows)
                names = [langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None) -> DataFrame:
    """Learn from the rows not held out and predict every row: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = fold(4, 2) if held_out is None else held_out
    model = train(rows.where(~held), vocabulary_path)
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def fold(of: int, which: int) -> Column:
    """Whether crc32 of the doc_id's text falls in a fold; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == which, F.lit(False))
