"""Quantizers and choices against one area at a time."""

import numpy as np
import pytest

from kinoframe.operators import quantize as Q
from kinoframe.operators.kernels import forward_dct, inverse_dct


def test_steps(spark):
    assert [Q.step_of(i) for i in (0, 1, 24, 25, 48, 49, 255, 999)] == [40, 40, 78, 80, 156, 160, Q.step_of(255), Q.step_of(255)]
    assert Q.step_of(303, 10) > Q.step_of(255, 10) == Q.step_of(255)
    d = spark.range(400).select(Q.step_column(__import__("pyspark").sql.functions.col("id"), 10).alias("s")).collect()
    assert [r["s"] for r in d] == [Q.step_of(i, 10) for i in range(400)]


def test_levels_one_by_one():
    rng = np.random.default_rng(1)
    for index in (1, 40, 120, 200):
        step = Q.step_of(index)
        c = rng.integers(-20000, 20001, 500)
        want = []
        for v in c.tolist():
            a = abs(v)
            level = ((a + step // 16) * ((1 << 23) // step)) >> 20 if a * 16 >= step else 0
            want.append(level if v >= 0 else -level)
        got = Q.quantized(c, step)
        assert got.tolist() == want
        assert (np.abs(Q.restored(got, step) - c) <= step // 8 + 1).all()


def pruned(level, most):
    out, gone = list(level), 0
    for at in reversed(Q.SCAN[1:]):
        if out[at] == 0:
            continue
        if abs(out[at]) > 1 or gone == most:
            break
        out[at] = 0
        gone += 1
    return out


def test_pruned_levels_one_by_one():
    rng = np.random.default_rng(2)
    level = rng.choice([0, 0, 0, 1, -1, 2], (400, 16))
    for most in (1, 3, 16):
        assert Q.without_last_units(level, most).tolist() == [pruned(row, most) for row in level.tolist()]
    small = Q.without_small(level, 1)
    assert (small[:, 0] == level[:, 0]).all() and set(np.unique(small[:, 1:])) == {0, 2}
    spread = np.array([5, 16384, 16385])
    assert [Q.small_limit(i, d, c, spread).tolist() for i, d, c in ((71, 8, True), (72, 8, True), (200, 8, False), (71, 10, True), (159, 10, False), (160, 12, True))] == [[0] * 3, [1, 1, 0], [0] * 3, [0] * 3, [3] * 3, [4] * 3]


def test_choices_one_by_one():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-128, 128, (200, 16)), rng.integers(-8, 9, (200, 16)), np.repeat(rng.integers(-128, 128, (50, 1)), 16, axis=1)])
    step = Q.step_of(140)
    got = Q.choices(x, step)
    plain = step // 8
    spread = lambda v: max(int((v * v).sum()) - (int(v.sum()) ** 2 + 8) // 16, 0)
    for i, r in enumerate(x):
        whole = Q.quantized(forward_dct(r.reshape(1, 4, 4)).ravel(), step)
        sets = [whole, np.array(pruned(whole.tolist(), 4)), np.array([v if k == 0 or abs(v) > 1 else 0 for k, v in enumerate(whole)]), np.array([whole[0]] + [0] * 15)]
        best = None
        for k, level in enumerate(sets):
            back = inverse_dct(Q.restored(level, step).reshape(1, 4, 4)).ravel()
            sse = int(((r - back) ** 2).sum())
            bits = sum(2 * (2 * abs(int(v)) + int(v <= 0)).bit_length() - 1 for v in level)
            score = bits + (sse + 2 * max(spread(r) - spread(back), 0)) // plain
            if best is None or (sse <= plain * plain * 16 // 9 and score < best[1]):
                best = (k, score, bits, sse, level.tolist())
        assert best == (got["choice"][i], got["score"][i], got["bits"][i], got["sse"][i], got["levels"][i].tolist())
    assert len(set(got["choice"].tolist())) >= 3


@pytest.mark.parametrize(("qp", "depth"), [(4, 8), (27, 8), (37, 8), (44, 10), (51, 12)])
def test_plain_levels_are_the_nearest(spark, qp, depth):
    from pyspark.sql import functions as F

    top = 1 << depth
    q = max(qp + (depth - 8) * 6, 4)
    scale, shift = Q.SKIP_SCALES[q % 6], 6 - q // 6
    back = lambda v: 0 if v == 0 else (v * scale + (1 << (shift - 1))) >> shift if shift > 0 else v * scale << -shift
    values = sorted({*range(-40, 41), *range(-top + 1, top, 37)})
    rows = spark.createDataFrame([(v,) for v in values], "r long").select("r", Q.skip_level(F.col("r"), qp, depth).alias("v")).collect()
    for r in rows:
        least = min((r["r"] - back(v)) ** 2 for v in range(r["v"] - 5, r["v"] + 6))
        assert (r["r"] - back(r["v"])) ** 2 == least and (r["r"] != 0 or r["v"] == 0)
