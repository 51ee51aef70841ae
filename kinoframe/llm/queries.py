"""The registered queries of the corpus operators and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, line_dedup, minhash, mixing, packing, periodic, prefix_trie, quality, substring, suffix_array, toxicity
from .common import spread

#: The vocabulary files: a parameter of the operators, here those of the installed public collection.
WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers on this machine find the package where the driver did; a cluster has it installed
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(documents(spark, sf_dir)).withColumn("removed", F.array_join("removed", ","))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), WORD_BPE)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), shingle=3, percent=85)


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    known = conversations.where(~chat.held_out(F.col("conv_id"))).select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), "role", "text")
    return chat.parse_transcripts(chat.transcript_passages(conversations), chat.fit(known)).select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "part", "role", "continues", "rendered")


def op7_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_verdicts(documents(spark, sf_dir))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), PIECE_BPE)


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_verdicts(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(documents(spark, sf_dir), rewrite=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_harmonic_packing, op3_minhash_near_dedup, op4_entropy_mixing, op5_exact_dedup, op6_chat_format, op7_substring_index, op8_quality_divergence, op9_language_id, op10_toxicity_nnpu, op11_suffix_array, op12_periodic_runs, op13_prefix_trie)
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i, l[i] AS line, list_sort(list_distinct(list_filter(regexp_split_to_array(l[i], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS w
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
), sets AS (SELECT w, min((doc_id, i)) AS first, len(w) AS n FROM lines WHERE len(w) >= 1 GROUP BY w),
numbered AS (SELECT *, row_number() OVER (ORDER BY first) AS u FROM sets),
tokens AS (SELECT u, n, unnest(w) AS t FROM numbered),
links AS (
    SELECT a.u AS a, b.u AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.u < b.u AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.u, b.u HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))
), both_ways AS (SELECT a AS u, b AS o FROM links UNION ALL SELECT b, a FROM links),
near AS (SELECT x.u, count(*) AS links, min(o.first) AS earliest FROM both_ways x JOIN numbered o ON o.u = x.o GROUP BY x.u),
told AS (
    SELECT l.doc_id, l.i, l.line, coalesce(links, 0) AS links, n.u IS NOT NULL AND ((l.doc_id, l.i) > n.first OR coalesce(earliest < (l.doc_id, l.i), false)) AS gone
    FROM lines l LEFT JOIN numbered n ON n.w = l.w LEFT JOIN near USING (u)
), per AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(links)::BIGINT AS n_links, coalesce(string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FILTER (gone), '') AS t
    FROM told GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_links, 0) AS n_links, coalesce(t, '') AS removed
FROM documents d LEFT JOIN per USING (doc_id)
""",
    "op3_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(na.n) + min(nb.n) - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS id, doc_id AS seen FROM documents
    UNION
    SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.seen
), least AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op7_substring_index": r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words)
), firsts AS (SELECT seq, min(doc_id) AS first FROM windows GROUP BY seq HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, s FROM windows JOIN firsts USING (seq) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hits),
kept AS (
    SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i)
), joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN joined USING (doc_id)
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op11_suffix_array": """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT r, s, substring(x, 2 * s + 1, 400) AS w FROM (SELECT r, x, unnest(range(len(x) // 2 - 199)) AS s FROM texts)),
hits AS (SELECT r, s FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
spans AS (
    SELECT r, min(s) AS a, max(s) + 200 AS b FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS span FROM (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM hits))
    GROUP BY r, span
), gaps AS (
    SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
    UNION ALL SELECT t.r, coalesce(max(b), 0), any_value(len(x)) // 2 FROM texts t LEFT JOIN spans s ON s.r = t.r GROUP BY t.r
), kept AS (SELECT g.r, string_agg(substring(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN texts USING (r) GROUP BY g.r),
counts AS (SELECT r, count(*) AS n, sum(b - a)::BIGINT AS removed FROM spans GROUP BY r)
SELECT doc_id, len(x)::BIGINT // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM texts JOIN kept USING (r) LEFT JOIN counts USING (r)
""",
    "op13_prefix_trie": r"""
WITH ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
    SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(s) + 1), lambda i: list_prepend(ascii(s[i])::BIGINT, list_transform(range(8), lambda j: -1::BIGINT))))),
            lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h
    FROM ids
), turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
    SELECT h.conv_id, 0 AS part, i, role, text FROM heads h JOIN turns t ON t.conv_id = base AND i < h
    UNION ALL SELECT h.conv_id, 1, i, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND i >= h
), placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, sha256(len(role) || ':' || role || text) AS turn, strlen(text) AS bytes FROM rebuilt),
prefixes AS (
    SELECT conv_id, d, string_agg(turn, '') OVER upto AS k, coalesce(string_agg(turn, '') OVER (upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent, bytes FROM placed WINDOW upto AS (PARTITION BY conv_id ORDER BY d)
    UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM ids
), long AS (SELECT conv_id, max(d) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT k, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, max(n) = any_value(d) AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
    FROM prefixes JOIN long USING (conv_id) GROUP BY k
), below AS (
    SELECT p.k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (n.depth = p.d + 1) AS n_children
    FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.k
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN nodes u ON u.k = n.parent
""",
}
