"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from compare_rows import duck_rows, spark_rows

from kinoframe.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn int, role string, text string, depth string, n_convs int"
COLUMNS = ["conv_id", "depth", "ends_sha256", "n_children", "n_convs", "n_leaves", "parent_conv_id", "saved_tokens"]


def table():
    rnd = random.Random(4)
    rows = []
    for c in range(60):
        hot = c % 3 == 0
        for t in range(rnd.choice([0, 1, 2, 5, 8, 12])):
            rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]) if not hot else "user", "hot" if hot else rnd.choice(["a", "bü", "", None, "c" * 50])))
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(130)]  # many blocks
    rows += [(201, t, "user", f"turn {t % 3}") for t in range(90)] + [(203, t, "user", f"turn {t % 3}") for t in range(130)]
    rows += [(None, 1, "user", "no conversation"), (-3, 1, "user", "a"), (-5, 2, None, None), (-5, 2, None, None)]
    return [(*r, "clash", 7) for r in rows]


def by_dictionary(rows, rebuild):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, totals = [], {}
    for k in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[k]]
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        totals[k] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in members[k] if built[c] == k)
        out.append((members[k][0], len(k), hashlib.sha256(ends.encode()).hexdigest(), len(below), len(members[k]), totals[k][0], members[k[:-1]][0] if k else None, totals[k][1]))
    return COLUMNS, sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize(("rebuild", "shard_rows", "block", "bits"), [(True, 100_000, 4096, 64), (True, 40, 4, 64), (False, 100, 16, 64), (True, 60, 8, 3)])
def test_equals_a_dictionary(spark, rebuild, shard_rows, block, bits):
    rows = table()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), rebuild, shard_rows, block, bits)
    assert spark_rows(got) == by_dictionary(rows, rebuild)


def test_equals_sql(spark):
    rows = table()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuild=True)
    assert spark_rows(got) == duck_rows(queries.ORACLES["op13_prefix_trie"], {"conversations": pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"conv_id": "Int64", "turn": "Int64"})})


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), rebuild=True).count() == 0


def test_perfect_slots():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50, (3000, 2)), axis=0)
    slots = prefix_trie.PerfectSlots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(len(keys)))
    assert (slots.keys[slots.find(keys)] == keys).all()
    assert (slots.find(keys + 1000) == -1).all()
