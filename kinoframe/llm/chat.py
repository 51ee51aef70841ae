"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are a role and whether a line begins or continues its turn. A line emits
its speaker marker (of which role, or none), whether it opens a passage, its
length class and whether it asks. Role changes, first roles, turn lengths and
line features are counted by Spark on labelled turns; markers have fixed odds.

Viterbi runs in blocks, as max-plus matrix products are associative: each
passage becomes a 6 x 6 matrix of best scores, passages join in blocks of 64
positions, blocks in blocks, until a transcript is one block. On the way back
every block learns the states it begins and ends in, and fixes those of its
members. A task works on many blocks at once: step by step over all of them.

Each turn is written as its role, its lines and an end mark; the mark comes
where the next turn begins, or the transcript ends, so a turn that goes on in
the next passage stays one. The rows of a transcript in order, one under the
other, are its canonical form.

Nulls: a null text is one empty line; rows with a null transcript id form one
transcript, null positions come first. Rows at one position go by their text,
and repeated rows share one place and one rendering. An empty table gives no
turns, and an untrained model has even odds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release
from .groups import changes, whole_groups

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2 + (0 begins, 1 continues)
SPAN = 64
#: Speaker markers of each role; fixed values.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "you", "question", "q"), "assistant": ("assistant", "ai", "bot", "answer", "a")}
_OF = {m: r for r, ms in MARKERS.items() for m in ms}
_MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|<\|?|\[)?(" + "|".join(sorted(_OF, key=len, reverse=True)) + r")(?:\*\*)?\s*(?::|\|?>|\])\s*(?:\*\*)?", re.IGNORECASE)
LENGTHS = (1, 4, 12, 40)
FEATURES = 2 * (len(LENGTHS) + 1)
#: Lines whose matrices a task holds at once.
LINES_AT_ONCE = 50_000

Model = dict[str, np.ndarray]


def marker_of(line: str) -> tuple[str | None, str]:
    """The role a line's speaker marker names, and the line without it."""
    m = _MARKER.match(line)
    return (_OF[m[1].lower()], line[m.end() :]) if m else (None, line)


def feature(line: str) -> int:
    """Length class, doubled, plus 1 for a question."""
    n = len(line.split())
    return 2 * sum(n >= x for x in LENGTHS) + line.rstrip().endswith("?")


def held_out(conv: Column) -> Column:
    """A fold of transcripts that a model is not fitted on: a quarter, by crc32."""
    return F.coalesce(F.crc32(conv.cast("string")) % 4 == 2, F.lit(False))


def fit(turns: DataFrame) -> Model:
    """Log odds from labelled turns (conv, pos, role, text): small tables of fixed size."""
    turns = turns.where(F.col("role").isin(*ROLES))
    change, first = np.ones((3, 3)), np.ones(3)
    follow = turns.select("conv", (F.col("pos") + 1).alias("pos"), F.col("role").alias("before"))
    here = turns.select("conv", "pos", "role")
    for r in here.join(follow, ["conv", "pos"], "left").groupBy("before", "role").count().collect():
        if r["before"] is None:
            first[ROLES.index(r["role"])] += r["count"]
        else:
            change[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["count"]

    def count(batches):
        seen = np.zeros((len(ROLES), 2, FEATURES), np.int64)
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, line in enumerate((text or "").split("\n")):
                    seen[ROLES.index(role), int(i > 0), feature(marker_of(line)[1])] += 1
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(seen[at])], names=["r", "later", "f", "n"])

    emit = np.ones((STATES, FEATURES))
    for r in turns.select("role", "text").mapInArrow(count, "r long, later long, f long, n long").groupBy("r", "later", "f").agg(F.sum("n").alias("n")).collect():
        emit[2 * r["r"] + r["later"], r["f"]] += r["n"]
    begun, later = emit[0::2].sum(axis=1), emit[1::2].sum(axis=1)
    stay = later / (begun + later)
    move = np.full((STATES, STATES), 1e-12)
    for s in range(STATES):
        move[s, 2 * (s // 2) + 1] = stay[s // 2]
        move[s, 0::2] = (1 - stay[s // 2]) * change[s // 2] / change[s // 2].sum()
    start = np.full(STATES, 1e-12)
    start[0::2] = first / first.sum()
    return {"move": np.log(move), "start": np.log(start), "emit": np.log(emit / emit.sum(axis=1, keepdims=True))}


def line_odds(model: Model) -> np.ndarray:
    """Log odds of every kind of line, by (feature, role of the marker or 3 for none, opens its passage, state)."""
    out = np.repeat(np.repeat(model["emit"].T[:, None, None, :], 4, axis=1), 2, axis=2)
    for s in range(STATES):
        begins = s % 2 == 0
        out[:, :3, :, s] += np.log(0.025 if begins else 0.01)
        out[:, 3, :, s] += np.log(0.5 if begins else 0.98)
        if begins:
            out[:, s // 2, :, s] += np.log(0.45 / 0.025)
        out[:, :, 1, s] += np.log(0.9 if begins else 0.05)
        out[:, :, 0, s] += np.log(0.1 if begins else 0.95)
    return out


class Lines:
    """The lines of some passages: each one's passage, marker, text without it, and step matrix."""

    def __init__(self, texts: list[str | None], heads: np.ndarray, model: Model, odds: np.ndarray):
        split = [(x or "").split("\n") for x in texts]
        self.count = np.array([len(x) for x in split], dtype=np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.text = [line for x in split for line in x]
        marked = [marker_of(line) for line in self.text]
        self.rest = [rest for _, rest in marked]
        self.marker = np.array([len(ROLES) if role is None else ROLES.index(role) for role, _ in marked], dtype=np.int64)
        opens = np.zeros(len(self.text), np.int64)
        opens[self.begin] = 1
        scores = odds[np.fromiter(map(feature, self.rest), np.int64, len(self.rest)), self.marker, opens]
        self.steps = model["move"][None] + scores[:, None, :]
        at = self.begin[heads]
        self.steps[at] = model["start"][None, None, :] + scores[at][:, None, :]


def products(m: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The max-plus product of each run of matrices (counts of one or more), neighbours first."""
    while (count > 1).any():
        of = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(m)) - np.repeat(np.cumsum(count) - count, count)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[of]))
        both = (m[left][:, :, :, None] + m[left + 1][:, None, :, :]).max(axis=2)
        m = m.copy()
        m[left] = both
        m = m[place % 2 == 0]
        count = (count + 1) // 2
    return m


def best_paths(m: np.ndarray, count: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state after each matrix, on the best path of each run; begin and end are its outer states, -1: any."""
    first, most = np.cumsum(count) - count, int(count.max(initial=0))
    score = np.where((begin[:, None] == np.arange(STATES)) | (begin[:, None] < 0), 0.0, -np.inf)
    back, out = np.zeros((len(m), STATES), np.int8), np.zeros(len(m), np.int64)
    for k in range(most):
        live = np.flatnonzero(count > k)
        full = score[live][:, :, None] + m[first[live] + k]
        back[first[live] + k] = full.argmax(axis=1)
        score[live] = full.max(axis=1)
    state = np.where(end < 0, score.argmax(axis=1), end)
    for k in range(most - 1, -1, -1):
        live = np.flatnonzero(count > k)
        out[first[live] + k] = state[live]
        state[live] = back[first[live] + k, state[live]]
    return out


_MATRIX = "array<double>"


def _matrices(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("m")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATES, STATES)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), STATES * STATES).cast(pa.list_(pa.float64()))


def _runs(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], changes(table, keys)]).astype(np.int64)
    return first, np.diff(np.append(first, table.num_rows))


def _up(batches):
    for table in whole_groups(batches, ["conv", "block"], LINES_AT_ONCE):
        first, count = _runs(table, ["conv", "block"])
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([table.column("conv").combine_chunks().take(at), table.column("block").combine_chunks().take(at), pa.array([""] * len(first)), _lists(products(_matrices(table), count))], names=["conv", "idx", "tie", "m"])


def _down(batches):
    """The states before and in each member of the blocks, whose own are in b and e."""
    for table in whole_groups(batches, ["conv", "block"], LINES_AT_ONCE):
        first, count = _runs(table, ["conv", "block"])
        b, e = (table.column(c).to_numpy() for c in ("b", "e"))
        states = best_paths(_matrices(table), count, b[first], e[first])
        before = np.concatenate([[0], states[:-1]])
        before[first] = b[first]
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("conv", "idx", "tie")), pa.array(before.astype(np.int32)), pa.array(states.astype(np.int32))], names=["conv", "idx", "tie", "begin", "end"])


def parse_transcripts(passages: DataFrame, model: Model) -> DataFrame:
    """Turns (conv, pos, part, role, continues, text, rendered) of passages (conv, pos, text), each of some lines."""
    shared = passages.sparkSession.sparkContext.broadcast((model, line_odds(model)))

    def pieces(batch):
        """Slices of a batch with a bounded number of lines."""
        sizes = np.array([1 if x is None else x.count("\n") + 1 for x in batch.column("text").to_pylist()])
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(LINES_AT_ONCE, int(sizes.sum()), LINES_AT_ONCE)) + 1
        edges = np.unique(np.concatenate([[0], cuts, [batch.num_rows]])).clip(max=batch.num_rows).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            yield part, Lines(part.column("text").to_pylist(), np.array(part.column("head").to_pylist(), bool), *shared.value)

    def matrices(batches):
        for batch in batches:
            for part, lines in pieces(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("conv", "idx", "tie")), _lists(products(lines.steps, lines.count))], names=["conv", "idx", "tie", "m"])

    base = passages.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("conv"), F.col("conv").alias("_conv"), F.coalesce("pos", F.lit(-1)).alias("at"), "pos", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("tie"))
    ends = base.groupBy("conv").agg(F.min(F.struct("at", "tie")).alias("low"), F.max(F.struct("at", "tie")).alias("high"))
    here = F.struct("at", "tie")
    lines = base.join(ends, "conv").withColumns({"idx": F.col("at") - F.col("low.at"), "head": here == F.col("low"), "last": here == F.col("high")})
    lines = durable(lines.drop("low", "high", "at"), "passages")
    # repeated rows are one member of a block
    level = durable(lines.select("conv", "idx", "tie", "text", "head").dropDuplicates(["conv", "idx", "tie"]).mapInArrow(matrices, f"conv string, idx long, tie string, m {_MATRIX}"), "level")
    levels, most = [level], level.agg(F.max("idx")).first()[0] or 0
    order = ["conv", "block", "idx", "tie"]
    while most >= SPAN:
        members = level.withColumn("block", F.floor(F.col("idx") / SPAN)).repartition("conv", "block").sortWithinPartitions(*order)
        level = durable(members.mapInArrow(_up, f"conv string, idx long, tie string, m {_MATRIX}"), "level")
        levels.append(level)
        most //= SPAN
    states = None
    for level in reversed(levels):
        members = level.withColumn("block", F.floor(F.col("idx") / SPAN))
        if states is None:  # one block a transcript, whose outer states are any
            members = members.withColumns({"b": F.lit(-1), "e": F.lit(-1)}).repartition("conv", "block")
        else:
            members = members.join(states, ["conv", "block"]).repartition("conv", "block")
        below = durable(members.sortWithinPartitions(*order).mapInArrow(_down, "conv string, idx long, tie string, begin int, end int"), "states")
        states = below.select("conv", F.col("idx").alias("block"), F.col("begin").alias("b"), F.col("end").alias("e"))
    for level in levels:
        release(level)

    def render(batches):
        for batch in batches:
            for part, lines in pieces(batch):
                begin, end = (part.column(c).to_numpy() for c in ("begin", "end"))
                path = best_paths(lines.steps, lines.count, begin, end)
                own = lines.marker == path // 2  # a marker of another role is part of the text
                body = [rest if x else text for x, rest, text in zip(own.tolist(), lines.rest, lines.text, strict=True)]
                new = path % 2 == 0
                opens = np.zeros(len(path), bool)
                opens[lines.begin] = True
                cut = np.flatnonzero(new | opens)
                row = np.repeat(np.arange(part.num_rows), lines.count)[cut]
                said = ["\n".join(body[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(body)], strict=True)]
                heads, lasts = (np.array(part.column(c).to_pylist(), bool) for c in ("head", "last"))
                is_head = heads[row] & opens[cut]
                is_last = lasts[row] & np.append(row[1:] != row[:-1], True)
                roles = [ROLES[s] for s in (path[cut] // 2).tolist()]
                rendered = [
                    ("" if head or not begins else "<|end|>\n") + (f"<|{role}|>\n" if begins or head else "") + text + ("\n<|end|>" if last else "")
                    for text, role, begins, head, last in zip(said, roles, new[cut].tolist(), is_head.tolist(), is_last.tolist(), strict=True)
                ]
                number = np.arange(len(cut)) - np.repeat(np.flatnonzero(opens[cut]), np.diff(np.append(np.flatnonzero(opens[cut]), len(cut))))
                at = pa.array(row)
                columns = [part.column("_conv").take(at), part.column("pos").take(at), pa.array(number.astype(np.int32)), pa.array(roles), pa.array(~new[cut] & ~is_head), pa.array(said), pa.array(rendered)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv", "pos", "part", "role", "continues", "text", "rendered"])

    full = lines.join(below, ["conv", "idx", "tie"])
    return full.select("_conv", "pos", "text", "head", "last", "begin", "end").mapInArrow(render, "conv long, pos long, part int, role string, continues boolean, text string, rendered string")


def transcript_passages(conversations: DataFrame) -> DataFrame:
    """conversations as passages of a raw transcript: two in three turns carry a speaker marker."""
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0
    marked = F.when(hidden, F.coalesce("text", F.lit(""))).otherwise(F.concat(F.initcap(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit(""))))
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("pos"), marked.alias("text"))
