"""Palettes, partitions, copies, crops and kernels against brute force."""

import itertools
import random

import numpy as np
import pytest

from kinoframe.operators import copies as M
from kinoframe.operators import crops as K
from kinoframe.operators import kernels as A
from kinoframe.operators import palettes as L
from kinoframe.operators import partition as T

PX = "frame long, row long, col long, px array<int>"


def best_cut(px, most):
    """By trying all cuts of the distinct samples; of equal ones that whose last segments begin first."""
    values = sorted(set(px))
    if len(values) <= most:
        return values
    found = []
    for cut in itertools.combinations(range(1, len(values)), most - 1):
        edges = [0, *cut, len(values)]
        cost, colours = 0, []
        for a, b in itertools.pairwise(edges):
            part = sorted(v for v in px if v in values[a:b])
            colours.append(part[(len(part) + 1) // 2 - 1])
            cost += sum(abs(v - colours[-1]) for v in part)
        found.append((cost, tuple(reversed(cut)), colours))
    return min(found)[2]


def test_palettes_are_the_best_cut():
    rnd = random.Random(2)
    for most in (1, 2, 3, 6):
        rows = [[rnd.choice([rnd.randrange(12), rnd.randrange(256)]) for _ in range(14)] for _ in range(40)] + [[5] * 14]
        got = L.medians(np.array(rows), most)
        for px, colours in zip(rows, got.tolist(), strict=True):
            assert [c for c in colours if c >= 0] == best_cut(px, most)


def test_regions_of_any_size(spark):
    rows = [("a", [7] * 5), ("b", [0]), ("c", []), ("d", [1, 9, 4]), ("e", list(range(100)))]
    got = {r["block_id"]: (r["palette"], r["indices"], r["cost"]) for r in L.median_palettes(spark.createDataFrame(rows, "block_id string, px array<int>")).collect()}
    assert got["a"] == ([0, 7], [1] * 5, 0) and got["b"] == ([0, 1], [0], 0) and got["c"] == ([], [], 0) and got["d"] == ([1, 4, 9], [0, 2, 1], 0)
    assert len(got["e"][0]) == 6 and got["e"][2] == sum(min(abs(v - c) for c in got["e"][0]) for v in range(100))
    order = L.frequency_order(spark.createDataFrame([("a", [3, 1, 2, 1, 3, 9])], "block_id string, px array<int>")).collect()
    assert order[0]["colours"] == [3, 1, 2, 9]


def leaves_of(spark, blocks, width, height):
    f = T.features(spark.createDataFrame(blocks, PX))
    got = T.partition_tree(f, spark.createDataFrame([(0, width, height)], "frame long, width long, height long")).collect()
    seen = np.zeros((height, width), int)
    for r in got:
        seen[r.y : r.y + r.height, r.x : r.x + r.width] += 1  # what stands out is cut off
        assert r.x + r.width // 2 <= width and r.y + r.height // 2 <= height
    assert (seen == 1).all()
    return {(r.x, r.y, r.width, r.height) for r in got}


def test_partitions_cover_their_picture_once(spark):
    flat = lambda rows, cols: [(0, r, c, [9] * 64) for r in range(rows) for c in range(cols)]
    busy = lambda rows, cols: [(0, r, c, [(i * 37 + r * 11 + c * 7) % 251 for i in range(64)]) for r in range(rows) for c in range(cols)]
    assert leaves_of(spark, flat(8, 8), 64, 64) == {(0, 0, 64, 64)}
    assert leaves_of(spark, busy(8, 8), 64, 64) == {(x, y, 16, 16) for x in range(0, 64, 16) for y in range(0, 64, 16)}
    # a palette-worthy block is a leaf of its own; its 16x16 area is cut around it
    few = [(*b[:3], [1, 200] * 32) if b[1:3] == (3, 5) else b for b in busy(8, 8)]
    small = {(32, 16, 16, 8), (32, 24, 8, 8), (40, 24, 8, 8)}
    assert leaves_of(spark, few, 64, 64) == {(x, y, 16, 16) for x in range(0, 64, 16) for y in range(0, 64, 16)} - {(32, 16, 16, 16)} | small
    for rows, cols in ((1, 1), (13, 22), (5, 3)):
        leaves_of(spark, busy(rows, cols), 8 * cols, 8 * rows)
        leaves_of(spark, flat(rows, cols), 8 * cols, 8 * rows)


def one_by_one(now, before, most):
    """The vectors in raster order, candidate after candidate, with an index that is made when first needed."""
    rows, cols = now.shape
    places = {}
    for r, c in np.ndindex(rows, cols):
        places.setdefault(before[r, c], []).append((r, c))
    found, index = {}, False
    near = [(s * r, s * c) for s in M.NEAR for r, c in M.DIRECTIONS]

    def hit(r, c, v):
        y, x = r + v[0], c + v[1]
        return 0 <= y < rows and 0 <= x < cols and before[y, x] == now[r, c]

    def asked(r, c):
        ref = places.get(now[r, c], [])
        return None if not ref or (most and len(ref) > most) else min(((y - r, x - c) for y, x in ref), key=lambda v: (abs(v[0]) + abs(v[1]), v))

    for r, c in np.ndindex(rows, cols):
        if now[r, c] < 0:
            continue
        tried = [(0, (0, 0))]
        for dr, dc in ((0, -1), (-1, 0), (-1, -1), (-1, 1)):
            if (r + dr, c + dc) in found:
                tried.append((1, found[r + dr, c + dc][1]))
        best = next((t for t in tried if hit(r, c, t[1])), None)
        if best is None and index and (v := asked(r, c)):
            best = (3, v)
        if best is None:
            best = next(((2, v) for _, p in tried for d in near if hit(r, c, v := (p[0] + d[0], p[1] + d[1]))), None)
        if best is None and not index:
            index = True
            if v := asked(r, c):
                best = (3, v)
        if best:
            found[r, c] = best
    return found


@pytest.mark.parametrize("most", [8, None])
def test_vectors_by_waves_are_those_one_by_one(most):
    rng = np.random.default_rng(5)
    for _ in range(60):
        rows, cols = rng.integers(1, 14, 2)
        before = rng.integers(0, rng.integers(2, 60), (rows, cols))
        now = np.roll(before, rng.integers(-3, 4, 2), (0, 1))
        change = rng.random((rows, cols)) < 0.3
        now = np.where(change, rng.integers(-1, 70, (rows, cols)), now)
        source, mv = M.vectors(now, before, most)
        got = {(r, c): (int(source[r, c]), tuple(mv[r, c].tolist())) for r, c in np.ndindex(rows, cols) if source[r, c] >= 0}
        assert got == one_by_one(now, before, most)


def test_sources_of_vectors(spark):
    """A picture that stays; a block that moves by one and by three columns."""
    block = lambda v: [v] * 64
    rows = [(f, r, c, block(10 * r + c)) for f in (0, 1) for r in range(2) for c in range(4)]
    rows += [(10, r, c, block(10 * r + c)) for r in range(2) for c in range(4)] + [(11, 0, 1, block(0)), (11, 1, 3, block(0))]
    rows += [(20, 0, c, block(c)) for c in range(4)] + [(21, 0, c, block(0 if c == 3 else 99)) for c in range(4)]
    got = {(r["frame"], r["row"], r["col"]): (r["source"], r["mv_row"], r["mv_col"]) for r in M.frame_vectors(spark.createDataFrame(rows, PX)).collect()}
    assert all(got[1, r, c] == ("zero", 0, 0) for r in range(2) for c in range(4))
    assert got[11, 0, 1] == ("local", 0, -1) and got[21, 0, 3] == ("index", 0, -3) and got[21, 0, 0] == (None, None, None) and got[0, 0, 0][0] is None
    total = {r["frame"]: (r["n_blocks"], r["n_zero"], r["n_none"]) for r in M.motion_totals(M.frame_vectors(spark.createDataFrame(rows, PX))).collect()}
    assert total[1] == (8, 8, 0) and total[0] == (8, 0, 8)


def test_copies_of_the_same_picture(spark):
    rng = random.Random(3)
    rows, cols = 10, 56
    px = {(r, c): rng.randrange(60) for r in range(rows) for c in range(cols)}
    df = spark.createDataFrame([(0, r, c, [v] * 64) for (r, c), v in px.items()], PX)
    order = lambda r, c: (r // 8, c // 8, sum((c >> k & 1) * 4**k + (r >> k & 1) * 2 * 4**k for k in range(3)))
    for tile in (None, 2):
        want = {}
        for (r, c), v in px.items():
            legal = [k for k, x in px.items() if x == v and order(*k) < order(r, c) and k[0] // 8 == r // 8 and c // 8 - k[1] // 8 <= 4 and (tile is None or k[1] // (8 * tile) == c // (8 * tile))]
            assert all(k[0] < r or k[1] < c for k in legal)
            if legal:
                want[r, c] = max(legal, key=lambda k: order(*k))
        got = {(t["row"], t["col"]): (t["ref_row"], t["ref_col"]) for t in M.picture_copies(df, tile).collect()}
        assert got == want and len(want) > 100
    # beside, above, and none in another row of superblocks
    small = spark.createDataFrame([(0, 0, 0, [1] * 64), (0, 0, 1, [1] * 64), (0, 1, 1, [1] * 64), (0, 8, 1, [1] * 64)], PX)
    assert sorted((t["row"], t["col"], t["kind"]) for t in M.picture_copies(small).collect()) == [(0, 1, "left"), (1, 1, "above")]


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_last_distinct_over_ranges(spark, span):
    rng = random.Random(6)
    rows = [("a", i * 3, str(rng.randrange(9))) for i in range(120)] + [("b", i, str(i % 3)) for i in range(20)] + [("c", 5, "x")]
    want = {}
    for s in "abc":
        history = []
        for _, at, v in [r for r in rows if r[0] == s]:
            history = ([h for h in history if h != v] + [v])[-5:]
            want[s, at] = ",".join(history)
    d = M.last_distinct(spark.createDataFrame(rows, "stream string, place long, value string"), span=span)
    assert {(r["stream"], r["place"]): r["history"] for r in d.collect()} == want


def test_crops_on_any_sample(spark):
    rng = np.random.default_rng(1)
    picture = rng.integers(0, 256, (48, 64))
    blocks = spark.createDataFrame([(4, r, c, picture[8 * r : 8 * r + 8, 8 * c : 8 * c + 8].ravel().tolist()) for r in range(6) for c in range(8)], PX)
    sizes = spark.createDataFrame([(4, 64, 48)], "frame long, width long, height long")
    crops = [("a", 4, 0, 0, 64, 48), ("b", 4, 3, 5, 16, 24), ("c", 4, 8, 7, 8, 8), ("d", 4, 55, 40, 8, 8), ("e", 4, 56, 1, 8, 40)]
    schema = "crop string, frame long, x0 long, y0 long, width long, height long"
    got = {(r["crop"], r["row"], r["col"]): r["px"] for r in K.crop_blocks(blocks, spark.createDataFrame(crops, schema), sizes).collect()}
    want = {(n, r, c): picture[y + 8 * r : y + 8 * r + 8, x + 8 * c : x + 8 * c + 8].ravel().tolist() for n, _, x, y, w, h in crops for r in range(h // 8) for c in range(w // 8)}
    assert got == want
    for bad in (("f", 4, 57, 0, 8, 8), ("f", 4, 0, -1, 8, 8), ("f", 5, 0, 0, 8, 8), ("f", 4, 0, 0, 9, 8)):
        with pytest.raises(Exception, match="leaves its picture"):
            K.crop_blocks(blocks, spark.createDataFrame([bad], schema), sizes).collect()
    with pytest.raises(Exception, match="block is missing"):
        K.crop_blocks(blocks.where("row != 1"), spark.createDataFrame([("f", 4, 0, 3, 8, 8)], schema), sizes).collect()


def test_sweeps_hang_on_the_seed_only(spark):
    sources = spark.createDataFrame([("a", 5, 192, 128), ("b", 1, 64, 64)], "source string, frames long, width long, height long")
    rows = lambda seed, n: sorted(map(tuple, K.crop_sweep(sources.repartition(n), seed, align_x=2, align_y=2).collect()))
    got = rows(3, 1)
    assert len(got) == 128 and got == rows(3, 5) and got != rows(4, 1)
    for crop, source, frame, x, y, w, h in got:
        pw, ph, frames = (192, 128, 5) if source == "a" else (64, 64, 1)
        assert crop == f"{source}_{w}x{h}" and 0 <= frame < frames and x + w <= pw and y + h <= ph and x % 2 == y % 2 == 0
    with pytest.raises(Exception, match="exceeds its source"):
        K.crop_sweep(spark.createDataFrame([("c", 1, 32, 64)], sources.schema), 3).collect()


def test_dct_comes_back():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-255, 256, (4000, 4, 4)), rng.choice([-255, 255], (4000, 4, 4)), np.full((1, 4, 4), 255), np.zeros((1, 4, 4), int)])
    c = A.forward_dct(x)
    assert np.abs(A.inverse_dct(c) - x).max() <= 7 and not c[-1].any()
    small = rng.integers(-20, 21, (4000, 4, 4))
    assert np.abs(A.inverse_dct(A.forward_dct(small)) - small).max() <= 1
    flat = A.forward_dct(np.full((1, 4, 4), 100))[0]
    assert flat[0, 0] == 3200 and np.abs(flat).sum() == 3200
    # rows that differ only from top to bottom have vertical frequencies only
    ramp = A.forward_dct(np.tile(np.array([10, 20, 30, 40])[:, None], (1, 1, 4)))[0]
    assert (np.abs(ramp[:, 1:]) <= 1).all() and ramp[1, 0] != 0
    deep = rng.integers(-1023, 1024, (500, 4, 4))
    assert np.abs(A.inverse_dct(A.forward_dct(deep), 10) - deep).max() <= 25


def test_directions_in_all_three_zones():
    above, left, corner = np.array([[10, 20, 30, 40, 50, 60, 70, 80]]), np.array([[11, 21, 31, 41, 51, 61, 71, 81]]), np.array([5])
    at = lambda angle: A.directional(angle, above, left, corner).reshape(4, 4)
    assert at(45).tolist() == [[min(20 + 10 * (x + y), 80) for x in range(4)] for y in range(4)]
    assert at(135).tolist() == [[5 if x == y else 10 * (x - y) if x > y else 10 * (y - x) + 1 for x in range(4)] for y in range(4)]
    flat = A.directional(157, above * 0 + 9, left * 0 + 9, corner * 0 + 9)
    assert (flat == 9).all()
    # nearer to the vertical the area follows the edge above, nearer to the horizontal the one to the left
    for angle in range(1, 90):
        assert at(angle).min() >= 10 and at(angle).max() <= 80
    for angle in [*range(91, 180), *range(181, 270)]:
        assert at(angle).min() >= 5 and at(angle).max() <= 81
    assert (np.abs(at(89) - above[0, :4]) <= 1).all() and (np.abs(at(91) - above[0, :4]) <= 1).all() and (np.abs(at(269) - left[0, 4]) <= 70).all()


def test_chroma_models(spark):
    """A plane that follows luma on a line; neighbours that are flat; blocks without neighbours."""
    rng = np.random.default_rng(4)
    luma = rng.integers(0, 256, (2, 3, 64))
    rows = [(0, r, c, luma[r, c].tolist(), (luma[r, c] // 2 + 30).tolist()) for r in range(2) for c in range(3)]
    rows += [(1, 0, c, [50] * 64, [90] * 64) for c in range(2)]
    got = {(r["frame"], r["row"], r["col"]): r for r in A.chroma_models(spark.createDataFrame(rows, PX + ", cb array<int>")).collect()}
    first = got[0, 0, 0]
    assert (first["a"], first["b"], first["shift"]) == (0, 128, 0)
    for r, c in ((0, 1), (1, 0), (1, 1), (1, 2)):
        m = got[0, r, c]
        assert 0.35 < m["a"] / 2 ** m["shift"] < 0.65
    assert (got[1, 0, 1]["a"], got[1, 0, 1]["b"], got[1, 0, 1]["sad"]) == (0, 90, 0)
