"""Harmonic packing of tokenised documents into sequences of at most 4096 tokens.

A piece of length n is of class k = floor(4096 / n): k such pieces fit in one
sequence. Every class fills its sequences with exactly k pieces, in groups that
share nothing, so workers pack alone. Documents are cut first, into whole
sequences, then powers of two down to 64 tokens, then a tail: powers of two
fill their sequences exactly, and what a group has left splits by the binary
digits of its count into shorter sequences of a power of two, which need no
padding. Tails (class 64, the last) are laid end to end, a new sequence
starting where one could no longer hold the longest tail.

Nulls: a null text counts as empty, whose only token is the end id. Repeated
rows are packed as often as they stand; equal pieces take different places.
Groups are dealt by row, so pieces of null or shared ids spread like others.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, durable, ragged, slices

CAPACITY, CLASSES, END_ID = 4096, 64, 2
#: Pieces of one class that a group holds: a bound for tasks, whatever the input.
GROUP_PIECES = 16_384
#: Characters that a task encodes at once: the more, the fewer repeats of a word are encoded.
ENCODE_CHARS = 8_000_000


#: Words of these characters need no Unicode normalisation, and lower-case one by one.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u024f]+")
_END, _LINE = "\x01", "\n"


class WordEncoder:
    """Token ids by words: the tokenizer never joins text across white space, so words encode alone.

    Plain words are lower-cased and split by the tokenizer's own pattern, and
    all parts run through tiktoken's merge loop in one call, each closed by a
    mark that stands for the word-end suffix. That loop merges by the rank of
    the joined bytes, not of the pair; both agree if each token comes out of
    its own text, since a span whose ends no merge crosses merges as it would
    alone. Tokens that fail this in the tokenizers library can never appear
    there and are left out of the ranks. Other words go to that library itself,
    and so do those that hold a special token's string, which it cuts out.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        config = json.loads(self.whole.to_str())
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in config["added_tokens"]) or "(?!)", regex.IGNORECASE)
        self.parts = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab, suffix = config["model"]["vocab"], config["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (x for x in range(256) if x not in printable)
        letter = {x: chr(x) for x in printable} | {x: chr(256 + k) for k, x in enumerate(rest)}  # byte-level alphabet
        byte = {c: x for x, c in letter.items()}

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + _END.encode() * end

        ids = {bytes([x]) + _END.encode(): vocab[c + suffix] for x, c in letter.items()}
        bare = Tokenizer(self.whole.model)
        # inside a word there is no suffix: "+x" puts a token without one in front of another letter
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in config["model"]["merges"]]
        closed = [t for t in merged if t.endswith(suffix)]
        alone = bare.encode_batch_fast([t[: -len(suffix)] for t in closed], add_special_tokens=False)
        lost = {t for t, code in zip(closed, alone, strict=True) if code.ids != [vocab[t]]}
        ids |= {raw(t): vocab[t] for t in merged if t not in lost}
        ids |= {bytes([x]): vocab[c] for x, c in letter.items()}
        self.core = tiktoken.Encoding("words", pat_str=f"[^{_END}{_LINE}]*{_END}|{_LINE}", mergeable_ranks={k: i for i, k in enumerate(ids)}, special_tokens={})
        self.true_id = np.array(list(ids.values()), dtype=np.uint32)
        self.line = list(ids).index(_LINE.encode())

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        marked = self.parts.sub(rf"\g<0>{_END}", "\n".join(words).lower() + "\n")
        codes = np.array(self.core.encode_ordinary(marked), dtype=np.int64)
        lines = np.flatnonzero(codes == self.line)
        return self.true_id[codes[codes != self.line]], np.diff(np.concatenate([[-1], lines])) - 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's offset in them."""
        words = Words(texts)
        distinct = words.distinct.to_pylist()
        is_plain = np.fromiter((PLAIN.fullmatch(w) is not None and not self.special.search(w) for w in distinct), bool, len(distinct))
        table, length = self.plain([w for w, x in zip(distinct, is_plain, strict=True) if x])
        odd = [np.array(x.ids, dtype=np.uint32) for x in self.whole.encode_batch_fast([w for w, x in zip(distinct, is_plain, strict=True) if not x], add_special_tokens=False)]
        each = np.zeros(len(distinct), np.int64)
        each[is_plain], each[~is_plain] = length, [len(x) for x in odd]
        begin = np.zeros(len(distinct), np.int64)
        begin[is_plain] = np.cumsum(length) - length
        begin[~is_plain] = len(table) + np.cumsum(each[~is_plain]) - each[~is_plain]
        table = np.concatenate([table, *odd])
        per_word = each[words.codes]
        ends = np.concatenate([[0], np.cumsum(per_word)])[words.offsets]
        return table[ragged(begin[words.codes], per_word)], ends


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker, for all its tasks."""
    return WordEncoder(path)


def cut_lengths(n: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: 4096s, powers of two from 2048 to 64, the rest."""
    out = [CAPACITY] * (n // CAPACITY)
    rest, size = n % CAPACITY, CAPACITY // 2
    while size >= CAPACITY // CLASSES:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _cutter(path: str, with_ids: bool):
    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for part in slices(batch, most=ENCODE_CHARS):
                flat, ends = encoder.ids(part.column("text"))
                rows = []
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(flat[ends[k] : ends[k + 1]], np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for n in cut_lengths(len(ids)):
                        data = ids[at : at + n].tobytes()
                        rows.append((doc, at, n, zlib.crc32(data), len(ids), data if with_ids else None))
                        at += n
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids (little-endian 32-bit) of each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer_path, with_ids), schema)


def harmonic_pack(pieces: DataFrame) -> DataFrame:
    """pieces (columns length, doc_id, start and any others) with sequence_id and offset.

    Lengths must be from 1 to 4096. The table is read twice and its rows are numbered, so make it durable.
    """
    n = F.col("length")
    k = F.least(F.floor(CAPACITY / n), F.lit(CLASSES)).cast("int")
    # a power of two that fills its sequence is a class of its own
    exact = (n * k == CAPACITY) & (F.bit_count(n) == 1)
    pieces = pieces.withColumn("_class", k * 2 + exact.cast("int"))
    counts = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}  # 130 rows at most
    groups = F.create_map(*(F.lit(x) for c, m in counts.items() for x in (c, -(-m // GROUP_PIECES)))) if counts else F.lit(None).cast("map<int,int>")
    pieces = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(groups, F.col("_class"))).cast("long"))
    line = Window.partitionBy("_class", "_group").orderBy("doc_id", "start", "length")
    before = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_class", "_group")
    d = pieces.withColumns({"_rank": F.row_number().over(line).cast("long") - 1, "_size": F.count("*").over(whole), "_at": F.sum("length").over(before) - F.col("length")})
    per, is_exact = F.floor(F.col("_class") / 2), F.col("_class") % 2 == 1
    full = F.floor(F.col("_size") / per)
    left, place = F.col("_size") % per, F.col("_rank") - full * per
    # the digit of `left` whose run holds this place: the highest in which the two differ
    digit = F.floor(F.log2(F.greatest(left.bitwiseXOR(F.greatest(place, F.lit(0))), F.lit(1)).cast("double"))).cast("long")
    tail = CAPACITY // CLASSES - 1
    bin_ = (
        F.when((per == CLASSES) & ~is_exact, F.floor(F.col("_at") / (CAPACITY - tail)))
        .when(is_exact & (place >= 0), full + digit)
        .otherwise(F.floor(F.col("_rank") / per))
    )
    d = d.withColumn("sequence_id", (F.shiftleft(F.col("_class").cast("long"), 48) + F.shiftleft("_group", 20) + bin_).cast("long"))
    first = F.min("_at").over(Window.partitionBy("_class", "_group", "sequence_id"))
    return d.withColumn("offset", F.col("_at") - first).drop("_class", "_group", "_rank", "_size", "_at")


def packed_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document with their places in the sequences."""
    return harmonic_pack(durable(token_pieces(docs, tokenizer_path, id_col, text_col, with_ids), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (array<int>) of each sequence; packed must hold ids. A group has 4096 tokens at most."""

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy())
        data = table.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(data[i] for i in order), dtype="<u4").astype(np.int32)
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "n_tokens": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens int, ids array<int>")
