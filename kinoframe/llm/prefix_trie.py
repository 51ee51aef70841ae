"""Conversation prefix trie: every distinct sequence of first turns, with counts of its members and of its subtree.

1. Turns get their place in a conversation from one range sort: a number that rises
   over the partitions, less the first of (conversation, partition), plus the rows before.
   A conversation of any length is spread over partitions.
2. A prefix has a 128-bit digest, the XOR of a hash of (place, turn) over its turns,
   summed in blocks of places and carried from block to block.
3. Blocks of conversations are dealt to shards of a bounded number of rows. A shard lists
   the distinct digests, gives each a slot by a minimal perfect hash that checks the
   stored digest, and scatters members, least member and longest member into flat arrays.
   The shards' tables are summed by digest: the nodes.
4. A node belongs to its least member: that row brings one leaf (if no member goes on) and
   the saved bytes. Shards scatter these into slots again, with what later blocks of a
   conversation hold at the end of a block, and add them up through the parents'
   slots, deepest first. Sums over shards are the sums over subtrees, as every row
   of a node's members lies below that node in its own shard.

Digests are checked: one turn fingerprint must stand for one (role, text), and one digest
for one parent digest and one fingerprint; then equal digests are equal prefixes, depth by
depth. If not, all is done again with other seeds and more bits.

Nulls: a null role or text is empty, a null turn comes first. Equal turns are ordered by
role and text. Rows without conv_id are of no conversation. An empty table has no node, not even the root.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, mix, release
from .groups import by_group

#: Rows of a shard on the average, and places of a conversation that stay together.
SHARD_ROWS, BLOCK = 100_000, 4096
#: Bits of a level of the perfect hash for a key that is left.
GAMMA = 2


class PerfectSlots:
    """A minimal perfect hash of distinct keys of two 64-bit numbers, shape (n, 2).

    Level by level, keys that alone hit a place of a bit array have their slot there; the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = np.zeros_like(keys)
        left, used = np.arange(len(keys)), 0
        while len(left):
            at = self._places(keys[left], len(self.levels), GAMMA * len(left) + 1)
            hits = np.bincount(at, minlength=GAMMA * len(left) + 1)
            bits = hits == 1
            rank = np.cumsum(bits) - 1 + used
            alone = bits[at]
            self.keys[rank[at[alone]]] = keys[left[alone]]
            self.levels.append((bits, rank))
            left, used = left[~alone], used + int(alone.sum())

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(keys[:, 0].view(np.uint64), level) ^ keys[:, 1].view(np.uint64), level + 1) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of one that is not there."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._places(keys[open_], level, len(bits))
            hit = bits[at]
            slot = rank[at[hit]]
            good = (self.keys[slot] == keys[open_[hit]]).all(axis=1)
            out[open_[hit]] = np.where(good, slot, -1)
            open_ = open_[~hit]
        return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    s = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return s[np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])] if len(s) else s


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _count_members(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard, with members, least member and longest member."""
    h1, h2, conv, length = _columns(table, "h1", "h2", "conv", "length")
    told = _columns(table, "depth", "p1", "p2", "f1", "f2", "bytes")
    keys = np.stack([h1, h2], axis=1)
    slots = PerfectSlots(_distinct(keys))
    slot, n = slots.find(keys), len(slots.keys)
    members, least, longest = np.bincount(slot, minlength=n), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(least, slot, conv)
    np.maximum.at(longest, slot, length)
    one = np.zeros(n, np.int64)
    one[slot] = np.arange(len(slot))
    clash = np.zeros(n, bool)
    for x in told:
        np.logical_or.at(clash, slot, x != x[one][slot])
    out = [slots.keys[:, 0], slots.keys[:, 1], *(x[one] for x in told), members, least, longest]
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out), pa.array(clash)], names=["h1", "h2", "depth", "p1", "p2", "f1", "f2", "bytes", "n_convs", "least", "longest", "clash"])


def _add_up(block: int):
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The parts of a shard in its nodes' children, leaves and saved bytes."""
        h1, h2, p1, p2, depth, own, leaf, saved = _columns(table, "h1", "h2", "p1", "p2", "depth", "own", "leaf", "saved")
        keys, parents = np.stack([h1, h2], axis=1), np.stack([p1, p2], axis=1)[depth > 0]
        slots = PerfectSlots(_distinct(np.concatenate([keys, parents])))
        slot, n = slots.find(keys), len(slots.keys)
        up = np.full(n, -1)
        up[slot[depth > 0]] = slots.find(parents)
        children, leaves, bytes_ = (np.zeros(n, np.int64) for _ in range(3))
        np.add.at(children, up[slot[(depth > 0) & own]], 1)
        np.add.at(leaves, slot, leaf)
        np.add.at(bytes_, slot, saved)
        deep = np.full(n, -1)
        deep[slot] = depth
        # the first place of a later block is not added up: the end of the block before has it already
        deep[(deep > 1) & ((deep - 1) % block == 0)] = -1
        order = np.argsort(deep, kind="stable")
        order = order[deep[order] > 0]
        for level in reversed(np.split(order, np.flatnonzero(np.diff(deep[order])) + 1)):
            np.add.at(leaves, up[level], leaves[level])
            np.add.at(bytes_, up[level], bytes_[level])
        live = (children != 0) | (leaves != 0) | (bytes_ != 0)
        out = [slots.keys[:, 0], slots.keys[:, 1], children, leaves, bytes_]
        yield pa.RecordBatch.from_arrays([pa.array(x[live]) for x in out], names=["h1", "h2", "children", "leaves", "saved"])

    return work


def _id_lists(batches):
    """Of sorted rows (h1, h2, conv), the ids of each run of one node, joined."""
    for batch in batches:
        if batch.num_rows:
            h1, h2, conv = (batch.column(c).to_numpy() for c in ("h1", "h2", "conv"))
            at = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, [len(h1)]])
            ids = conv.astype(str).tolist()
            joined = [",".join(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            at = at[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), pa.array(conv[at]), pa.array(joined)], names=["h1", "h2", "first", "ids"])


def _id_digests(batches):
    """Of sorted lists, the digest of each node's whole list, list after list."""
    key, digest = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["h1", "h2", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "ids")), strict=True):
            if key == (a, b):
                digest.update(b"," + ids.encode())
            else:
                if key:
                    yield told()
                key, digest = (a, b), hashlib.sha256(ids.encode())
    if key:
        yield told()


def _hash(seed: int, bits: int, *columns: Column) -> Column:
    h = F.xxhash64(F.lit(seed), *columns)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


class _Clash(Exception):
    """One digest stands for two things."""


def _turns(conversations: DataFrame, seed: int, bits: int) -> DataFrame:
    """All turns in order, numbered, with their fingerprints."""
    empty = F.lit("")
    t = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).where("conv is not null")
    t = t.withColumn("salt", F.monotonically_increasing_id()).orderBy("conv", F.col("turn").asc_nulls_first(), "role", "text", "salt")
    kinds = [_hash(seed, bits, F.col("role"), F.col("text")).alias("f1"), _hash(seed + 1, bits, F.col("text"), F.col("role")).alias("f2")]
    t = t.select("conv", "role", "text", F.octet_length("text").cast("long").alias("bytes"), *kinds).withColumn("n", F.monotonically_increasing_id())
    out = durable(t, "trie-turns")
    content = F.struct("role", "text")
    if out.groupBy("f1", "f2").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a != b").head(1):
        release(out)
        raise _Clash
    return out


def _placed(turns: DataFrame, rebuild: bool) -> tuple[DataFrame, DataFrame]:
    """(conv, place, f1, f2, bytes, length) of all turns as rebuilt; (conv, length) of all conversations."""
    part = F.shiftright("n", 33)
    turns = turns.drop("role", "text").withColumn("part", part)
    each = turns.groupBy("conv", "part").agg(F.min("n").alias("low"), F.count("*").alias("rows"))
    mine = Window.partitionBy("conv")
    before = F.coalesce(F.sum("rows").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9 if rebuild else F.lit(0).cast("long")
    base = F.col("conv") - F.pmod("conv", F.lit(5))
    each = each.select("conv", "part", "low", before.alias("before"), F.sum("rows").over(mine).alias("total"), head.alias("head"), base.alias("base"))
    bases = each.where("conv = base and before = 0").select(F.col("conv").alias("b"), F.col("total").alias("base_total"))
    each = each.join(bases, F.col("base") == F.col("b"), "left").withColumn("given", F.least("head", F.coalesce("base_total", F.lit(0))))
    each = durable(each.withColumn("length", F.col("given") + F.greatest(F.col("total") - F.col("head"), F.lit(0))).drop("b", "base_total"), "trie-parts")
    at = turns.join(each, ["conv", "part"]).withColumn("i", F.col("before") + F.col("n") - F.col("low"))
    own = at.where("i >= head").select("conv", (F.col("i") - F.col("head") + F.col("given")).alias("place"), "f1", "f2", "bytes", "length")
    convs = each.where("before = 0").select("conv", "base", "head", "length")
    if rebuild:
        heads = at.where("conv = base and i < 8").select("base", F.col("i").alias("place"), "f1", "f2", "bytes")
        own = own.union(heads.join(convs, "base").where("place < head").select("conv", "place", "f1", "f2", "bytes", "length"))
    return own, convs.select("conv", "length")


def _prefixes(placed: DataFrame, convs: DataFrame, seed: int, bits: int, block: int) -> DataFrame:
    """A row for each conversation and depth, from 0: digest and parent's digest."""
    place = [F.col("place"), F.col("f1"), F.col("f2")]
    r = placed.withColumn("block", F.floor(F.col("place") / block)).withColumns({"v1": _hash(seed + 2, bits, *place), "v2": _hash(seed + 3, bits, *place)})
    sums = r.groupBy("conv", "block").agg(F.bit_xor("v1").alias("c1"), F.bit_xor("v2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumns({f"h{k}": F.bit_xor(f"v{k}").over(inside) for k in (1, 2)}).join(carry, ["conv", "block"])
    r = r.withColumns({f"h{k}": F.col(f"h{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2)})
    zero = F.lit(0).cast("long")
    deep = r.select("conv", "length", "block", (F.col("place") + 1).alias("depth"), "h1", "h2", *(F.col(f"h{k}").bitwiseXOR(F.col(f"v{k}")).alias(f"p{k}") for k in (1, 2)), "f1", "f2", "bytes")
    return deep.union(convs.select("conv", "length", zero, zero, zero, zero, zero, zero, zero, zero, zero))


def _sharded(rows: DataFrame, work, schema: str) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(by_group(["shard"], work), schema)


def _trie(conversations: DataFrame, rebuild: bool, shard_rows: int, block: int, seed: int, bits: int) -> DataFrame:
    turns = _turns(conversations, seed, bits)
    rows = durable(_prefixes(*_placed(turns, rebuild), seed, bits, block), "trie-prefixes")
    release(turns)
    shards = max(1, -(-rows.count() // shard_rows))
    # conversations of near ids, which often begin alike, share a shard
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv") / 5), "block"), F.lit(shards)).alias("shard")
    longs = "h1 long, h2 long, depth long, p1 long, p2 long, f1 long, f2 long, bytes long, n_convs long, least long, longest long, clash boolean"
    local = _sharded(rows.select("*", shard), _count_members, longs)
    told = ["depth", "p1", "p2", "f1", "f2", "bytes"]
    nodes = local.groupBy("h1", "h2").agg(
        F.sum("n_convs").alias("n_convs"), F.min("least").alias("conv_id"), F.max("longest").alias("longest"), F.max("clash").alias("clash"),
        *(F.min(c).alias(c) for c in told), *(F.max(c).alias(f"{c}_too") for c in told),
    )
    nodes = durable(nodes.withColumn("clash", F.expr(" or ".join(["clash", *(f"{c} != {c}_too" for c in told)]))).drop(*(f"{c}_too" for c in told)), "trie-nodes")
    if nodes.where("clash").head(1):
        release(rows)
        raise _Clash

    owned = nodes.select(F.col("conv_id").alias("conv"), "depth", "n_convs", "longest")
    zero = F.lit(0).cast("long")
    r = rows.join(owned, ["conv", "depth"], "left").select(
        "conv", "length", "block", "depth", "h1", "h2", "p1", "p2", F.col("n_convs").isNotNull().alias("own"),
        F.when(F.col("longest") == F.col("depth"), 1).otherwise(0).cast("long").alias("leaf"),
        F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), zero).alias("saved"),
    )
    r = durable(r, "trie-owned")
    later = Window.partitionBy("conv").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    more = r.groupBy("conv", "block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s")).select("conv", "block", F.sum("l").over(later).alias("l"), F.sum("s").over(later).alias("s")).where("l is not null")
    last = F.col("depth") == F.least((F.col("block") + 1) * block, F.col("length"))
    ends = [F.col(c) + F.when(last, F.coalesce(k, zero)).otherwise(0) for c, k in (("leaf", "l"), ("saved", "s"))]
    carried = r.join(more, ["conv", "block"], "left").select(shard, "h1", "h2", "p1", "p2", "depth", "own", ends[0].alias("leaf"), ends[1].alias("saved"))
    sums = _sharded(carried, _add_up(block), "h1 long, h2 long, children long, leaves long, saved long")
    sums = sums.groupBy("h1", "h2").agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    stops = r.where("depth = length").select("h1", "h2", "conv").orderBy("h1", "h2", "conv")
    lists = stops.mapInArrow(_id_lists, "h1 long, h2 long, first long, ids string")
    digests = lists.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(_id_digests, "h1 long, h2 long, ends_sha256 string")
    parents = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent"))
    out = nodes.join(sums, ["h1", "h2"], "left").join(digests, ["h1", "h2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", *(F.coalesce(c, zero).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, rebuild: bool = False, shard_rows: int = SHARD_ROWS, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. With rebuild, each conversation c first takes the first h turns of conversation
    c - c % 5 in place of its own first h, h = crc32 of the decimal c, modulo 9. hash_bits: of each half of a digest, to begin with.
    """
    seed = 0
    while True:
        try:
            return _trie(conversations, rebuild, shard_rows, block, seed, hash_bits)
        except _Clash:
            seed, hash_bits = seed + 4, min(64, 2 * hash_bits)
