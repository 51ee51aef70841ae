"""Line deduplication by an exact set-similarity join.

A line is the set of its distinct words. Lines of PERCENT % Jaccard similarity
or more are links; a line goes if an earlier one (by doc_id, then place) links
to it, itself kept or not, or has the same set. Equal sets are one unit, known by
a 128-bit hash, so a line repeated in a third of all documents costs one unit.
Units meet by rarity-ordered prefixes under length and positional filters, and
those that may be similar form families (see setjoin). A family's lines come
together once, in blocks; Jaccard is verified there on the words of all of them,
and a unit's number of links and earliest link leave the task.

Nulls: a null text has no lines; a row without doc_id keeps its lines and is
compared with none. Lines of fewer than min_words distinct words stay; with
MIN_WORDS every line that has a word is judged, one without stays.
Rows that share a doc_id get one verdict: a place is removed if one of their lines there is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, distinct, durable, hash128, mix, ragged, slices
from .groups import blocks_for, changes, similar, whole_groups
from .setjoin import Counters, families

PERCENT, MIN_WORDS = 80, 1
#: Smaller sets have no similar set but their equals, which need no join: 3 of 4 words are under PERCENT.
LEAST_JOINED = 4


class LineSets:
    """The distinct words of every line of a slice of texts, and a 128-bit key of each set."""

    def __init__(self, texts: pa.Array):
        self.lines = [(x or "").split("\n") for x in texts.to_pylist()]
        self.row = np.repeat(np.arange(len(self.lines)), [len(x) for x in self.lines])
        self.place = np.concatenate([*(np.arange(len(x)) for x in self.lines), np.zeros(0, np.int64)]).astype(np.int64)
        flat = [y for x in self.lines for y in x]
        w = Words(pa.array(flat, pa.string()))
        size = max(1, len(w.distinct))
        pair = distinct(w.row * size + w.codes)
        self.of, code = pair // size, pair % size
        h = hash128(w.distinct)[code] if len(code) else np.zeros((0, 2), np.uint64)
        self.tokens = h[:, 0]
        self.offsets = np.searchsorted(self.of, np.arange(len(flat) + 1))
        self.n = np.diff(self.offsets)
        self.keys = []
        for k in (0, 1):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h[:, k], 21 + k), dtype=np.uint64)])
            self.keys.append(mix(sums[self.offsets[1:]] - sums[self.offsets[:-1]], 31 + k).view(np.int64))


SURVEY = "doc_id long, n_lines long, k1 long, k2 long, place int, n int, bucket int, uses long"
ARROW = {"long": pa.int64(), "int": pa.int32()}


def _survey(min_words: int):
    """Three kinds of rows: documents with their number of lines; lines with enough words, and the keys and sizes
    of their sets; how many words of the lines that the join takes fall to each counter, in all of a task."""
    fields = {x.split()[0]: ARROW[x.split()[1]] for x in SURVEY.split(", ")}

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in fields.items()], names=list(fields))

    def run(batches):
        counters = Counters()
        for batch in batches:
            for part in slices(batch):
                s = LineSets(part.column("text"))
                docs = part.column("doc_id")
                counters.add(s.tokens[(s.n >= max(min_words, LEAST_JOINED))[s.of]])
                empty = [x is None for x in part.column("text").to_pylist()]
                yield batch_of(len(docs), doc_id=docs, n_lines=[0 if e else len(x) for e, x in zip(empty, s.lines, strict=True)])
                use = np.flatnonzero(s.n >= min_words)
                yield batch_of(len(use), doc_id=docs.take(pa.array(s.row[use])), k1=s.keys[0][use], k2=s.keys[1][use], place=s.place[use].astype(np.int32), n=s.n[use].astype(np.int32))
        for bucket, uses in counters.rows():
            yield batch_of(len(bucket), bucket=bucket, uses=uses)

    return run


def _unit_sets(min_words: int):
    def sets(part: pa.RecordBatch):
        s = LineSets(part.column("text"))
        use = s.n >= max(min_words, LEAST_JOINED)
        keep = use[s.of]
        return s.tokens[keep], np.concatenate([[0], np.cumsum(s.n[use])]).astype(np.int64), s.keys[0][use]

    return sets


#: Lines of a block of a family, on the average; lines taken up at once; a family of so few is compared pair by pair.
BLOCK_LINES, FAMILY_ROWS, FEW, PAIRS_AT_ONCE = 4096, 4096, 32, 100_000
DEALT = ["family", "lo", "hi"]
FAMILY = ("family", "blocks", "own", "k1", "k2", "doc_id", "place", "line")


def _wanted(batches):
    """The text of the lines at the wanted places, with what is known of their sets."""
    for batch in batches:
        for part in slices(batch):
            tags = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(tags.offsets.to_numpy()))
            tag = tags.flatten()
            lines = [(x or "").split("\n") for x in part.column("text").to_pylist()]
            found = [lines[r][p] if p < len(lines[r]) else "" for r, p in zip(row.tolist(), tag.field("place").to_pylist(), strict=True)]
            known = {c: tag.field(c) for c in FAMILY[:5] + ("place",)} | {"doc_id": part.column("doc_id").take(pa.array(row)), "line": pa.array(found, pa.string())}
            keys = LineSets(known["line"]).keys  # rows that share an id may have other lines there
            same = (keys[0] == known["k1"].to_numpy()) & (keys[1] == known["k2"].to_numpy())
            yield pa.RecordBatch.from_arrays([known[c] for c in FAMILY], names=FAMILY).filter(pa.array(same))


class Found:
    """For each row, how many others are similar and the least rank of those."""

    def __init__(self, rank: np.ndarray):
        self.rank, self.links, self.least = rank, np.zeros(len(rank), np.int64), np.full(len(rank), len(rank), np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.links, x, 1)
        np.minimum.at(self.least, x, self.rank[y])


def _links_in_families(batches):
    """Of each set of a family, or of two blocks of one: how many others are similar, and the earliest line of those."""
    for table in whole_groups(batches, DEALT, FAMILY_ROWS):
        c = {k: table.column(k).to_numpy() for k in ("own", "k1", "k2", "doc_id", "place", "lo", "hi")}
        c["group"] = np.zeros(table.num_rows, np.int64)
        c["group"][changes(table, DEALT)] = 1
        c["group"] = np.cumsum(c["group"])
        order = np.lexsort((c["place"], c["doc_id"], c["k2"], c["k1"], c["group"]))
        again = np.ones(max(len(order) - 1, 0), bool)
        for k in ("group", "k1", "k2"):
            again &= c[k][order][1:] == c[k][order][:-1]
        order = order[np.concatenate([[True], ~again])]  # a line of repeated rows is one set
        c = {k: x[order] for k, x in c.items()}
        w = Words(table.column("line").combine_chunks().take(pa.array(order)))
        size = max(1, len(w.distinct))
        pair = distinct(w.row * size + w.codes)
        offsets = np.searchsorted(pair, np.arange(len(order) + 1) * size)
        n = np.diff(offsets)
        early = np.lexsort((c["place"], c["doc_id"]))
        rank = np.empty(len(order), np.int64)
        rank[early] = np.arange(len(order))
        found, across = Found(rank), c["lo"] != c["hi"]
        first = np.flatnonzero(np.concatenate([[True], c["group"][1:] != c["group"][:-1]]))
        many = np.diff(np.append(first, len(order)))
        for a, g in zip(first[many > FEW].tolist(), many[many > FEW].tolist(), strict=True):
            link = similar(pair[offsets[a] : offsets[a + g]] % size, offsets[a : a + g + 1] - offsets[a], PERCENT)
            if across[a]:
                link &= c["own"][a : a + g, None] != c["own"][None, a : a + g]
            found.links[a : a + g] = link.sum(axis=1)
            by_rank = np.argsort(rank[a : a + g])
            some = np.flatnonzero(link.any(axis=1))
            found.least[a + some] = rank[a + by_rank[link[some][:, by_rank].argmax(axis=1)]]
        # small families: every two of their sets, all at once
        rows = ragged(first[many <= FEW], many[many <= FEW])
        end = np.repeat((first + many)[many <= FEW], many[many <= FEW])
        left, right = np.repeat(rows, end - rows - 1), ragged(rows + 1, end - rows - 1)
        use = (100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right])) & (~across[left] | (c["own"][left] != c["own"][right]))
        left, right = left[use], right[use]
        for k in range(0, len(left), PAIRS_AT_ONCE):
            x, y = left[k : k + PAIRS_AT_ONCE], right[k : k + PAIRS_AT_ONCE]
            wanted = np.repeat(y, n[x]) * size + pair[ragged(offsets[x], n[x])] % size
            hit = pair[np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)] == wanted
            both = np.bincount(np.repeat(np.arange(len(x)), n[x]), hit, len(x)).astype(np.int64)
            ok = (both > 0) & (100 * both >= PERCENT * (n[x] + n[y] - both))
            found.add(x[ok], y[ok])
            found.add(y[ok], x[ok])
        use = np.flatnonzero(found.links)
        other = early[found.least[use]]
        columns = [c["k1"][use], c["k2"][use], found.links[use], c["doc_id"][other], c["place"][other]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "links", "first_doc", "first_place"])


def _cut(batches):
    for batch in batches:
        for part in slices(batch):
            out = []
            for x, gone in zip(part.column("text").to_pylist(), part.column("removed").to_pylist(), strict=True):
                drop = set(gone or ())
                out.append(None if x is None else "\n".join(line for i, line in enumerate(x.split("\n")) if i not in drop))
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns(["removed"])


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_links (links of its lines' sets), removed (places from 0)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = durable(source.mapInArrow(_survey(min_words), SURVEY), "survey")
    places = survey.where("k1 is not null and doc_id is not null").select("doc_id", "k1", "k2", "place", "n")
    key = ["k1", "k2"]
    first = places.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    least = places.groupBy(*key, "doc_id").agg(F.min("place").alias("first_place"), F.first("n").alias("n"))
    units = durable(least.join(first, [*key, "doc_id"]).withColumnRenamed("doc_id", "first_doc"), "units")

    named = source.where("doc_id is not null")
    family = families(named, _unit_sets(min_words), PERCENT, survey.where("bucket is not null").select("bucket", F.col("uses").alias("n")))
    members = units.join(family, F.col("k1") == family["id"]).select("component", *key, "first_doc", "first_place", "n")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("t")).select("component", blocks_for(F.col("m"), F.col("t"), BLOCK_LINES).alias("blocks"))
    tags = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    tags = tags.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("component").alias("family"), "blocks", "own", *key, F.col("first_place").alias("place"))).alias("wanted"))
    lines = named.join(tags, "doc_id").mapInArrow(_wanted, "family long, blocks int, own int, k1 long, k2 long, doc_id long, place int, line string")
    lines = lines.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    near = lines.select(*DEALT, "own", *key, "doc_id", "place", "line").repartition(*DEALT).sortWithinPartitions(*DEALT).mapInArrow(_links_in_families, "k1 long, k2 long, links long, first_doc long, first_place int")
    near = durable(near.groupBy(*key).agg(F.sum("links").alias("links"), F.min(F.struct("first_doc", "first_place")).alias("earliest")), "line-links")
    # only sets that are repeated or linked decide anything: most lines drop out here
    known = units.join(near, key, "left").where("copies > 1 or links > 0").select(*key, F.struct("first_doc", "first_place").alias("first"), "earliest", F.coalesce("links", F.lit(0)).alias("links"))
    here = F.struct(F.col("doc_id").alias("first_doc"), F.col("place").alias("first_place"))
    told = places.join(known, key).select("doc_id", "place", "links", ((here > F.col("first")) | F.coalesce(F.col("earliest") < here, F.lit(False))).alias("gone"))
    per = told.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("place")))).alias("removed"), F.sum("links").alias("n_links"))
    out = survey.where("n_lines is not null").select("doc_id", "n_lines").join(per, "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id and the text that stays."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = line_verdicts(source, min_words=min_words).where("n_removed > 0").select("doc_id", "removed").dropDuplicates(["doc_id"])
    return source.join(gone, "doc_id", "left").mapInArrow(_cut, "doc_id long, text string")
