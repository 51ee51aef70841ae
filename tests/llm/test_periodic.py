"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinoframe.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """By trying all periods at all places."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            part = w[s : s + length]
            if length >= max(24, 3 * q) and not any(part[p:] == part[: length - p] for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def verdict(doc_id, text, rewrite):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if rewrite and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


words = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 60)), max_size=6).map(lambda parts: [x for p, k in parts for x in (p * k)[: 5 * k]])


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=5))
def test_all_runs_of_many_texts(texts):
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = periodic.runs_of(codes, offsets).tolist()
    assert got == [[s + int(o), n, q] for t, o in zip(texts, offsets, strict=False) for s, n, q in all_runs(t)]


def table():
    rnd = random.Random(9)
    text = lambda n, k: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "ab c " * 12 + "ab", "\x0bü ö\t" * 40, text(2000, 2), text(3000, 26), ("x " * 30 + "y ") * 9]
    texts += [text(rnd.randint(1, 400), rnd.choice([2, 3, 26])) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(5, "a " * 24), (5, "b c " * 20), (None, "d " * 50), (None, None), (-7, "e " * 40)]


def test_query_equals_all_periods(spark):
    rows = table()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, period string, n_runs int")
    for rewrite in (False, True):
        got = periodic.periodic_runs(docs, rewrite=rewrite)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted((verdict(*r, rewrite) for r in rows), key=key)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_one_long_text_of_one_word():
    n = 200_000
    assert periodic.runs_of(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, n, 1]]


def test_collapse_keeps_other_texts_and_columns(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", None), (2, "x y\n" * 20 + " z", "k"), (3, None, "k"), (4, "", None)], "doc_id long, text string, period string")
    assert sorted(map(tuple, periodic.collapse_runs(docs).collect())) == [(1, "a  b\nc", None), (2, "x y z", "k"), (3, None, "k"), (4, "", None)]
