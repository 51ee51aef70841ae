"""Repeated 200-byte strings against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from compare_rows import duck_rows, spark_rows

from kinoframe.llm import queries, suffix_array

SCHEMA = "doc_id long, text string, anchors string, n_bytes int"


def table():
    rnd = random.Random(8)
    text = lambda n, abc="abcdefgh ü\n": "".join(rnd.choice(abc) for _ in range(n))
    passage, long = text(600), text(5000)
    texts = [None, "", "short", text(199), text(200), "x" * 1000, "ab" * 700, "=" * 260 + text(50), text(30) + "=" * 400]
    texts += [text(300) for _ in range(8)]
    texts += [long, long, long[:2500] + "edit" + long[2500:], long[1:], "z" + long[:-7]]
    for k in (199, 200, 201, 250, 330, 600):
        a = rnd.randrange(601 - k)
        texts += [text(rnd.randint(0, 90)) + passage[a : a + k] + text(rnd.randint(0, 90)) for _ in range(4)]
    texts += [text(40) + passage[100:330] + text(40) for _ in range(60)]  # one passage, many surroundings
    texts += [passage[:250] + text(10) + passage[:250], text(700, "ab")]
    texts += [texts[-1][100:400] + text(3, "xyz") + texts[-1][300:]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, long), (None, passage), (7, passage[50:]), (7, text(250)), (3, None)]
    return [(*r, "clash", 9) for r in rows]


def by_dictionary(rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (doc_id, *_), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc_id, hashlib.sha256(kept).hexdigest(), len(d), int(gone.sum()), spans))
    return ["doc_id", "kept_sha256", "n_bytes", "n_removed", "n_spans"], sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("bucket", [8192, 3])
def test_equals_a_dictionary(spark, bucket):
    rows = table()
    got = spark_rows(suffix_array.suffix_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket=bucket))
    assert got == by_dictionary(rows)


def test_equals_sql(spark):
    rows = table()
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})
    assert spark_rows(suffix_array.suffix_verdicts(spark.createDataFrame(rows, SCHEMA))) == duck_rows(queries.ORACLES["op11_suffix_array"], {"documents": frame})


def test_empty_table(spark):
    assert suffix_array.suffix_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_give_the_same_anchors(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    data[2000:5000] = data[100:130].repeat(100)
    data[6000:7000] = 97
    offsets = np.array([0, 0, 150, 4000, 8990, 9000, 9000])
    found = []
    for piece in (1 << 18, 700, 333):
        monkeypatch.setattr(suffix_array, "PIECE", piece)
        a = suffix_array.Anchors(data, offsets)
        order = np.argsort(a.x)
        found.append({k: v[order].tolist() for k, v in vars(a).items()})
    assert found[0] == found[1] == found[2]
    covered = sorted(x - k for x, n, f in zip(found[0]["x"], found[0]["near"], found[0]["far"], strict=True) for k in range(n, f + 1))
    assert covered == [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in range(a, b - 199)]


def test_cover_order():
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.integers(0, 2, 700), np.zeros(500, int), np.tile(rng.integers(0, 3, 300), 3), rng.integers(0, 256, 300)]).astype(np.uint8)
    starts = rng.permutation(len(data) - 250)
    group = rng.integers(0, 2, len(starts))
    order, same = suffix_array.CoverOrder(data).sort(starts, group)
    keys = [(group[i], data[starts[i] : starts[i] + 200].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert same.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]
