"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other documents are
unlabelled, whatever else is known of them. The risk of a linear scorer with
sigmoid loss l is

    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])

with the class prior taken from the labelled rows; when the second term is
negative, the step goes against it, so that the scorer doesn't fit the noise of
the unlabelled. Features are whether a word (a lower-cased run of letters)
occurs. Learning uses bounded samples, chosen by hash: at most MOST_POSITIVE and
MOST_UNLABELLED documents and MOST_WORDS words; scoring reads every whole text.

Reruns agree: samples are drawn by hash and learnt from in the order of ids and texts. MOST_WORDS bounds
the memory of a task that scores, as every task holds all weights; words below a lift of 0.7 (twice as
frequent in confirmed documents) tell little and would let noise in. Neither bound touches a row.

Nulls: a null or empty text scores as a text without any known word. Labels
without a document and null labels teach nothing. Without positives all scores
are the prior, 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, slices
from .langid import SCORE_CHARS, fold, letter_text

MOST_POSITIVE, MOST_UNLABELLED, MOST_WORDS, LEAST_DOCS, LEAST_SHARE = 4000, 12_000, 20_000, 3, 0.01
STEPS, RATE, DECAY = 400, 0.1, 1e-5


def _word_docs(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(letter_text(part.column("text")))
            pair = np.unique(w.row * len(w.distinct) + w.codes) if len(w.codes) else np.zeros(0, np.int64)
            n = np.bincount(pair % max(1, len(w.distinct)), minlength=len(w.distinct))
            positive = np.array(part.column("positive").to_pylist(), bool)
            own = np.bincount((pair % max(1, len(w.distinct)))[positive[pair // max(1, len(w.distinct))]], minlength=len(w.distinct)) if len(pair) else n
            yield pa.RecordBatch.from_arrays([w.distinct, pa.array(own.astype(np.int64)), pa.array((n - own).astype(np.int64))], names=["word", "p", "u"])


def _rows(vocabulary):
    """Of each text, the places of the vocabulary's words in it."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for part in slices(batch, most=SCORE_CHARS):
                rows = presence(part.column("text"), known)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "positive", "words"])

    return run


def presence(texts: pa.Array, known: dict[str, int]) -> list[np.ndarray]:
    w = Words(letter_text(texts))
    feature = np.array([known.get(x, -1) for x in w.distinct.to_pylist()] + [-1], dtype=np.int64)[w.codes]
    use = feature >= 0
    pair = np.unique(w.row[use] * (len(known) + 1) + feature[use])
    row = pair // (len(known) + 1)
    cuts = np.searchsorted(row, np.arange(len(w.counts) + 1))
    values = (pair % (len(known) + 1)).astype(np.int32)
    return [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def nnpu_gradient(w: np.ndarray, at: np.ndarray, of: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient) of the risk at weights w, the last one the bias; at, of: word and row of each occurrence.

    Where the negative part is below 0 the gradient is that of its opposite, so that a step raises it.
    """
    n = len(w) - 1
    s = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(is_p)) + w[n], -30, 30)))
    slope = s * (1 - s)  # l(-) = s and l(+) = 1 - s
    negative = s[~is_p].mean() - prior * s[is_p].mean()
    to_negative = np.where(is_p, -prior / max(1, is_p.sum()), 1 / max(1, (~is_p).sum())) * slope
    to_positive = np.where(is_p, -prior / max(1, is_p.sum()), 0.0) * slope
    g = to_positive + to_negative if negative >= 0 else -to_negative
    return prior * (1 - s[is_p]).mean(), negative, np.append(np.bincount(at, g[of], n), g.sum())


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, by full-batch Adam on the non-negative risk."""
    rows = positive + unlabelled
    at, of = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positive)
    w = np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        grad = nnpu_gradient(w, at, of, is_p, prior)[2] + DECAY * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def train(rows: DataFrame, marks: DataFrame) -> tuple[dict[str, float], float, float]:
    """Word weights, bias and class prior from rows (doc_id, text) and marks (doc_id, toxic), one row a document."""
    ids = rows.select("doc_id").join(marks, "doc_id", "left")
    seen = ids.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("toxic").alias("n"), F.count("*").alias("all")).first()
    if not seen["p"] or seen["all"] == seen["p"]:
        return {}, -30.0, 0.0
    prior = min(max(seen["p"] / seen["n"], 0.01), 0.9)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("positive"), min(1.0, MOST_POSITIVE / seen["p"])).otherwise(min(1.0, MOST_UNLABELLED / (seen["all"] - seen["p"])))
    drawn = ids.select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("positive")).where(draw < share).dropDuplicates(["doc_id"])
    # some 16,000 ids, by the two bounds: small enough to send to every task
    sample = durable(rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "positive"), "toxic-sample")
    counts = sample.mapInArrow(_word_docs, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = max(1, min(MOST_POSITIVE, seen["p"])), max(1, min(MOST_UNLABELLED, seen["all"] - seen["p"]))
    lift = F.log((F.col("p") + 0.5) / n_p) - F.log((F.col("u") + 0.5) / n_u)
    # a word of few positives may come from copies of one document
    counts = counts.where(F.col("p") >= max(LEAST_DOCS, LEAST_SHARE * n_p))
    top = counts.withColumn("lift", lift).where(F.col("lift") > 0.7).orderBy(F.desc(F.col("p") * F.col("lift")), "word").limit(MOST_WORDS)
    words = [r["word"] for r in top.select("word").collect()]
    known = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    found = sample.mapInArrow(_rows(known), "doc_id long, positive boolean, words array<int>").toPandas()
    # learning sums in the order of rows, so that order is the documents', not that of arrival
    found = found.assign(key=[tuple(x) for x in found["words"]]).sort_values(["doc_id", "key"])
    lists = [np.asarray(x, dtype=np.int32) for x in found["words"]]
    p_rows, u_rows = [x for x, ok in zip(lists, found["positive"], strict=True) if ok], [x for x, ok in zip(lists, found["positive"], strict=True) if not ok]
    # the unlabelled set as drawn lacks the confirmed documents; add them back at their share of all text
    u_rows = u_rows + p_rows[: int(len(u_rows) * seen["p"] / (seen["all"] - seen["p"]))]
    weights, bias = fit_nnpu(p_rows, u_rows, len(words), prior)
    return dict(zip(words, weights.tolist(), strict=True)), bias, prior


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """doc_id and score of every row (doc_id, text)."""
    words = list(weights)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, np.array([weights[w] for w in words] or [0.0])))

    def run(batches):
        known, w = shared.value
        for batch in batches:
            for part in slices(batch, most=SCORE_CHARS):
                z = np.array([w[x].sum() + bias for x in presence(part.column("text"), known)], dtype=float)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Learn from the rows not held out and score every row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    held = fold(5, 0) if held_out is None else held_out
    weights, bias, _ = train(rows.where(~held), marks)
    return score(rows, weights, bias).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
