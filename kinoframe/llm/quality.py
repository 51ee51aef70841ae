"""Quality rules by distribution divergence, in DataFrame expressions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows.
The verdict then compares two histograms of a document with references of the
languages below: its character classes, and its common words against all
others. A reference sums the counts of every document of a language that the
base rules keep, then once more of those that a first judgement keeps; any
language of LEAST_DOCS such documents has one. The distance is Jensen-Shannon
(base 2, square root, 0 to 1), the least over the document's own language and
those of COMMON; a document is rejected when it is over a threshold, and each
distance has a minimum length under which it is not judged. Common words are
judged in the languages of COMMON only, as the lists are fixed.

Nulls: a null text has no words, so the base rules reject it. A document whose
lang is null or has no reference is left to the base rules, and so is every
document where there is no reference at all, as in an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, durable, numbered, words_of

WS = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of each language; fixed values.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "with"),
    "de": ("der", "die", "und", "den", "von", "zu", "mit", "ist", "das", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "un", "une", "que", "dans"),
    "es": ("el", "en", "y", "los", "se", "del", "las", "por", "con", "una"),
}
BINS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
References = dict[str, tuple[list[float], list[float] | None]]
#: Documents that pass the base rules, for a language to have a reference.
LEAST_DOCS = 20
MIN_CLASS_CHARS, MIN_COMMON_WORDS = 250, 100
#: (base, noise): a sample of n counts may be base + noise / sqrt(n) away, as a short text strays further.
CLASS_LIMIT, COMMON_LIMIT = (0.10, 2.9), (0.15, 1.7)
FIRST_SLACK = 1.6


def repeated_words(words: str) -> Column:
    """Words that lie in a 5-word window which the array column `words` holds twice or more.

    Windows are hashed, sorted with their places, and the places of equal
    neighbours merged: n log n for any text. Only texts whose windows are not
    all distinct are sorted.
    """
    five = ", ".join(f"h[i + {k}]" for k in range(5))
    windows = f"CASE WHEN size(h) >= 5 THEN transform(sequence(0, size(h) - 5), i -> xxhash64({five})) ELSE array() END"
    hashes = f"transform({words}, x -> xxhash64(x))"
    starts = """sort_array(transform(filter(sequence(0, size(p) - 1),
        j -> get(p, j).k <=> get(p, j - 1).k OR get(p, j).k <=> get(p, j + 1).k), j -> get(p, j).i))"""
    covered = "aggregate(sequence(0, size(s) - 1), 0L, (n, j) -> n + least(5, coalesce(get(s, j + 1) - get(s, j), 5)))"
    places = f"transform(array(sort_array(transform(w, (k, i) -> named_struct('k', k, 'i', i)))), p -> {starts})"
    # transform over a one-element array names a value, so that it is computed once
    return F.expr(
        f"transform(transform(array({hashes}), h -> {windows}), w -> CASE WHEN size(array_distinct(w)) = size(w) THEN 0L "
        f"ELSE get(transform({places}, s -> {covered}), 0) END)[0]"
    )


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each document: those of the base rules, its character classes and common words (arrays of long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"), words_of(text).alias("words"))
    lines = F.expr(rf"filter(split(text, '\n'), l -> l rlike r'[^{WS}]')")
    # all but the small letters: a fifth of a text or so, in which the other classes are counted
    d = d.select("*", F.length("text").cast("long").alias("n_chars"), lines.alias("lines"), F.regexp_replace("text", r"\p{Ll}+", "").alias("rest"), F.split(F.lower("text"), r"[^\p{L}]+").alias("letters"))
    upper, digit, space, stop, symbol = (F.regexp_count("rest", F.lit(x)).cast("long") for x in (r"\p{Lu}", r"\p{Nd}", f"[{WS}]", "[.,;:!?]", f"[{SYMBOLS}]"))
    d = d.withColumns({"n_spaces": space, "n_symbols": symbol})
    # a letter for each common word of a text
    letter = F.create_map(*(F.lit(x) for k, w in enumerate(BINS) for x in (w, chr(ord("A") + k))))
    d = d.withColumn("short", F.array_join(F.transform(F.filter("letters", lambda w: w.isin(*BINS)), lambda w: F.element_at(letter, w)), ""))
    hits = F.array(*((F.octet_length("short") - F.octet_length(F.replace("short", F.lit(chr(ord("A") + k)), F.lit("")))).cast("long") for k in range(len(BINS))))
    classes = [F.col("n_chars") - F.length("rest"), upper, digit, F.col("n_spaces"), stop, F.col("n_symbols")]
    return (
        d.select(
            "doc_id",
            "lang",
            F.size("words").cast("long").alias("n_words"),
            (F.col("n_chars") - F.col("n_spaces")).alias("word_chars"),
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words("words").alias("n_repeat_words"),
            _with_rest(F.array(*classes), F.col("n_chars")).alias("classes"),
            _with_rest(hits, F.size(F.filter("letters", lambda w: w != "")).cast("long")).alias("common"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def _with_rest(counts: Column, total: Column) -> Column:
    """counts and, last, what total has beyond their sum; counts are computed once."""
    whole = lambda c: F.concat(c, F.array(total - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))
    return F.transform(F.array(counts), whole)[0]


def references(counts: DataFrame) -> References:
    """Shares of character classes and, for the languages of COMMON, of common words: one small row for each
    language of LEAST_DOCS documents or more."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c, n in (("classes", len(CLASSES)), ("common", len(BINS) + 1)) for i in range(n)]
    out = {}
    for row in counts.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= LEAST_DOCS).collect():
        a = [row[f"classes_{i}"] for i in range(len(CLASSES))]
        b = [row[f"common_{i}"] for i in range(len(BINS) + 1)]
        if sum(a):
            out[row["lang"]] = ([x / sum(a) for x in a], [x / sum(b) for x in b] if row["lang"] in COMMON and sum(b) else None)
    return dict(sorted(out.items()))


def _distance(shares: Column, reference: list[Column] | Column) -> Column:
    """Jensen-Shannon distance of an array column of shares from a reference's; null if either is."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(shares, F.array(*reference) if isinstance(reference, list) else reference, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(total > 0, F.sqrt(total)).when(total.isNotNull(), 0.0)


def _shares(counts: str) -> Column:
    return F.expr(f"transform(array(aggregate({counts}, 0L, (a, x) -> a + x)), n -> transform({counts}, x -> x / n))[0]")


def judge(counts: DataFrame, refs: References, slack: float = 1.0) -> DataFrame:
    """counts with class_distance and common_distance (null where not judged) and kept."""
    rows = {"class_distance": ("classes", 0, MIN_CLASS_CHARS, CLASS_LIMIT), "common_distance": ("common", 1, MIN_COMMON_WORDS, COMMON_LIMIT)}
    d, far = counts, F.lit(False)
    for name, (column, k, least_n, (base, noise)) in rows.items():
        n = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
        known = {lang: ref[k] for lang, ref in refs.items() if ref[k]}
        shared = [_distance(F.col("_shares"), [F.lit(x) for x in known[lang]]) for lang in COMMON if lang in known]
        judged = (n >= least_n) & (F.col("lang").isin(*known) if known else F.lit(False))
        d = d.withColumn("_shares", F.when(judged, _shares(column)))
        if own := [lang for lang in known if lang not in COMMON]:
            table = F.create_map(*(x for lang in own for x in (F.lit(lang), F.array(*map(F.lit, known[lang])))))
            d = d.withColumn("_own", F.element_at(table, F.col("lang")))
            shared.append(_distance(F.col("_shares"), F.col("_own")))
        d = d.withColumn(name, F.array_min(F.array(*shared)) if shared else F.lit(None).cast("double")).drop("_shares", "_own")
        far |= F.coalesce(F.col(name) > slack * (base + noise / F.sqrt(n)), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, both distances and kept."""
    counts = durable(base_counts(docs, id_col, text_col, lang_col), "quality-counts")
    first = references(counts.where(~F.col("base_failed")))
    # junk pulls the first references its way, so the first judgement is a lenient one
    refs = first | references(judge(counts, first, FIRST_SLACK).where("kept"))
    return judge(counts, refs).drop("lang", "classes", "common")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, whatever ids they share; all columns as they were."""
    rows = numbered(docs, "quality-rows")
    gone = quality_verdicts(rows, ROW).where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
