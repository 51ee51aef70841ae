"""Block arithmetic as whole-batch array kernels: the 4x4 DCT pair, directional prediction, chroma predicted from luma.

Spark deals the blocks out and brings neighbours together; a kernel takes the blocks of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The forward transform: cosines times 2^14, rows by frequency. The inverse: integer kernel. Fixed values.
FORWARD_BITS = 14
FORWARD = ((11585, 11585, 11585, 11585), (15137, 6270, -6270, -15137), (11585, -11585, -11585, 11585), (6270, -15137, 15137, -6270))
INVERSE = ((64, 64, 64, 64), (83, 35, -35, -83), (64, -64, -64, 64), (35, -83, 83, -35))
#: Shifts of the inverse's two passes. Fixed values.
INVERSE_SHIFTS = (7, 10)

#: 64 times the cotangent of an angle of 0 to 89 degrees, as the format rounds it. Fixed values.
SLOPES = (
    0, 4096, 2048, 1365, 1024, 819, 682, 585, 512, 455, 409, 409, 409, 372, 341, 292, 273, 256, 227, 215, 204, 186, 178, 170, 157, 151, 146, 136, 132, 128,
    117, 110, 107, 99, 97, 97, 93, 87, 83, 81, 77, 74, 73, 69, 66, 64, 62, 59, 56, 55, 53, 50, 49, 47, 44, 42, 42, 41, 38, 37,
    35, 32, 31, 30, 28, 27, 26, 24, 23, 22, 20, 19, 18, 16, 15, 14, 12, 11, 10, 10, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1,
)
#: Directions in degrees. Fixed values.
ANGLES = (45, 67, 113, 135, 157, 203)
AREA, EDGE = 4, 8
#: Pulls of a smooth prediction to the edge near it, of 64, by distance. Fixed values.
PULLS = (32, 8, 2, 0)

#: Significands of 16 / d for the sixteenths d of a power of two, less 8. Fixed values.
RECIPROCALS = (0, 7, 6, 5, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1, 1, 0)


def square(values: pa.Array, width: int) -> np.ndarray:
    """An Arrow array of lists of one length as a matrix."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) != len(values) * width:
        raise ValueError(f"lists of {width} values are wanted")
    return flat.reshape(len(values), width)


def lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def batches(work: Callable[[pa.RecordBatch], dict[str, pa.Array]]):
    """work on each batch that has rows, for mapInArrow."""

    def run(source):
        for batch in source:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def forward_dct(x: np.ndarray) -> np.ndarray:
    """Coefficients (n, 4, 4) of residuals (n, 4, 4), rows by vertical frequency, 32 times the mean first."""
    m = np.array(FORWARD, np.int64)
    half = 1 << (FORWARD_BITS - 1)
    x = x * 16
    x[:, 0, 0] += x[:, 0, 0] != 0
    once = (m @ x + half) >> FORWARD_BITS
    return (((once @ m.T + half) >> FORWARD_BITS) + 1) >> 2


def inverse_dct(c: np.ndarray, depth: int = 8) -> np.ndarray:
    """Residuals (n, 4, 4) of coefficients, clamped to what samples of `depth` bits can differ by.

    The two fixed kernels are not quite inverse to each other (35 / 83 is not the tangent that the cosines have): a
    residual comes back to at most 2.3 % of the range and 1, so to 7 at 8 bits, and to 1 if it is below 20.
    """
    m, wide = np.array(INVERSE, np.int64), 1 << (depth + 7)
    first, second = INVERSE_SHIFTS
    c = np.clip(c, -wide, wide - 1)
    once = np.clip((c @ m + (1 << (first - 1))) >> first, -wide, wide - 1)
    return np.clip((m.T @ once + (1 << (second - 1))) >> second, -(1 << depth), (1 << depth) - 1)


def quarters(px: np.ndarray) -> np.ndarray:
    """The 4x4 quarters (n, 4, 4, 4) of 8x8 blocks (n, 64), in raster order."""
    return px.reshape(-1, 2, 4, 2, 4).transpose(0, 1, 3, 2, 4).reshape(-1, 4, 4, 4)


def _dct(depth: int):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = quarters(square(batch.column("px"), 64) - (1 << (depth - 1))).reshape(-1, 4, 4)
        c = forward_dct(x)
        back = inverse_dct(c, depth)
        ids = np.repeat(batch.column("block_id").to_numpy(), 4)
        return {"block_id": pa.array(ids), "quarter": pa.array(np.tile(np.arange(4), batch.num_rows)), "coefficients": lists(c.reshape(-1, 16)), "error": pa.array(np.abs(back - x).max(axis=(1, 2)))}

    return batches(work)


def dct_quarters(blocks: DataFrame, depth: int = 8) -> DataFrame:
    """A row a 4x4 quarter: block_id, quarter, coefficients (16, of the samples less the middle value) and the largest error of their inverse."""
    return blocks.select("block_id", F.col("px").cast("array<int>").alias("px")).mapInArrow(_dct(depth), "block_id long, quarter long, coefficients array<long>, error long")


def areas(blocks: DataFrame, depth: int = 8) -> DataFrame:
    """The 4x4 areas of pictures with their edges: frame, y, x (in areas), px (16), above (8), left (8), corner, has_above, has_left.

    above goes on into the area above to the right, left into the one below to the left; where that is not there its
    last sample is repeated. Without an area above, above is one less than the middle value, without one to the left, left
    is one more; a corner that is not there is the first sample of the edge that is, or the middle value. Every block sends its
    edges to its neighbours, so one grouping of blocks brings them together; areas are cut out of a block and its edges.
    """
    middle = 1 << (depth - 1)
    cut = lambda v, *at: F.array(*(F.col(v)[i] for i in at))
    across = lambda y, x: cut("px", *(8 * y + x + i for i in range(4)))
    down = lambda y, x: cut("px", *(8 * (y + i) + x for i in range(4)))
    to = lambda kind, dy, dx, v: F.struct(F.lit(kind).alias("kind"), (F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col"), v.alias("v"))
    bottom, right = F.slice("px", 57, 8), cut("px", *range(7, 64, 8))
    sent = F.array(
        to("px", 0, 0, F.col("px")), to("above", 1, 0, bottom), to("beyond", 1, -1, across(7, 0)), to("left", 0, 1, right), to("below", -1, 1, down(0, 7)), to("corner", 1, 1, cut("px", 63)),
        to("beside", 0, -1, across(3, 0)), to("under", -1, 0, down(0, 3)),
    )
    m = blocks.select("frame", F.explode(sent).alias("m")).select("frame", "m.*")
    got = m.groupBy("frame", "row", "col").agg(*(F.max(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in ("px", "above", "beyond", "left", "below", "corner", "beside", "under"))).where("px is not null")
    there = lambda c, low: F.when(F.col(c).isNotNull(), F.slice(c, low + 1, 4))

    def area(y: int, x: int, **edges: Column) -> Column:
        pick = F.array(*(F.col("px")[8 * (y + r) + x + c] for r in range(4) for c in range(4)))
        return F.struct((F.col("row") * 2 + y // 4).alias("y"), (F.col("col") * 2 + x // 4).alias("x"), pick.alias("px"), *(v.alias(k) for k, v in edges.items()))

    four = F.array(
        area(0, 0, above=there("above", 0), beyond=there("above", 4), left=there("left", 0), below=there("left", 4), corner=F.col("corner")[0]),
        area(0, 4, above=there("above", 4), beyond=F.col("beyond"), left=down(0, 3), below=down(4, 3), corner=F.col("above")[3]),
        area(4, 0, above=across(3, 0), beyond=across(3, 4), left=there("left", 4), below=F.col("below"), corner=F.col("left")[3]),
        area(4, 4, above=across(3, 4), beyond=F.col("beside"), left=down(4, 3), below=F.col("under"), corner=F.col("px")[27]),
    )
    d = got.select("frame", F.explode(four).alias("t")).select("frame", "t.*")
    edge = lambda near, far, none: F.when(F.col(near).isNull(), F.array_repeat(F.lit(none), EDGE)).otherwise(F.concat(near, F.coalesce(far, F.array_repeat(F.col(near)[3], 4))))
    corner = F.when(F.col("above").isNull(), F.coalesce(F.col("left")[0], F.lit(middle))).when(F.col("left").isNull(), F.col("above")[0]).otherwise(F.col("corner"))
    return d.select("frame", "y", "x", "px", edge("above", "beyond", middle - 1).alias("above"), edge("left", "below", middle + 1).alias("left"), corner.alias("corner"), F.col("above").isNotNull().alias("has_above"), F.col("left").isNotNull().alias("has_left"))


def along_edge(edge: np.ndarray, slope: int, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Samples that lie `slope` / 64 places on along an edge (n, 8) for each step away from it; beyond the end its last sample."""
    far = slope * (across + 1)
    base, part = (far >> 6) + along, (far & 63) >> 1
    at = np.minimum(base, EDGE - 2)
    mixed = (edge[:, at] * (32 - part) + edge[:, at + 1] * part + 16) >> 5
    return np.where(base >= EDGE - 1, edge[:, -1:], mixed)


def directional(angle: int, above: np.ndarray, left: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The 4x4 areas (n, 16) predicted from their edges in a direction of 1 to 269 degrees, but for 90 and 180."""
    y, x = np.divmod(np.arange(AREA * AREA), AREA)
    if angle < 90:
        return along_edge(above, SLOPES[angle], x, y)
    if angle > 180:
        return along_edge(left, SLOPES[270 - angle], y, x)
    dx, dy = SLOPES[180 - angle], SLOPES[angle - 90]
    top, side = (np.concatenate([corner[:, None], e], axis=1) for e in (above, left))  # place -1 first
    far_x, far_y = (x << 6) - (y + 1) * dx, (y << 6) - (x + 1) * dy
    base_x, base_y = far_x >> 6, np.maximum(far_y >> 6, -1)
    blend = lambda e, base, part: (e[:, base + 1] * (32 - part) + e[:, base + 2] * part + 16) >> 5
    return np.where(base_x >= -1, blend(top, np.maximum(base_x, -1), (far_x & 63) >> 1), blend(side, base_y, (far_y & 63) >> 1))


def plain_predictions(above: np.ndarray, left: np.ndarray, corner: np.ndarray, has_above: np.ndarray, has_left: np.ndarray, depth: int = 8) -> dict[str, np.ndarray]:
    """The 4x4 areas (n, 16) that follow from their edges without a direction: dc, v, h, paeth and three smooth ones, in order of preference.

    dc is the rounded mean of the edges that are there, the middle value if none is. The smooth ones draw a line from the edge to the
    fifth sample of the other edge and pull it to the edge near it by 32, 8, 2, 0 of 64.
    """
    y, x = np.divmod(np.arange(AREA * AREA), AREA)
    round_ = lambda v, bits: (v + (1 << (bits - 1))) >> bits
    a, b = above[:, :AREA].sum(axis=1), left[:, :AREA].sum(axis=1)
    dc = np.where(has_above & has_left, round_(a + b, 3), np.where(has_above, round_(a, 2), np.where(has_left, round_(b, 2), 1 << (depth - 1))))
    v, h, k = above[:, x], left[:, y], corner[:, None]
    base = v + h - k
    off = [np.abs(base - e) for e in (h, v, k)]
    paeth = np.where((off[0] <= off[1]) & (off[0] <= off[2]), h, np.where(off[1] <= off[2], v, k))
    weight = np.array(PULLS)
    down = left[:, AREA, None] + round_((v - left[:, AREA, None]) * (AREA - 1 - y), 2)
    across = above[:, AREA, None] + round_((h - above[:, AREA, None]) * (AREA - 1 - x), 2)
    down, across = down + round_((v - down) * weight[y], 6), across + round_((h - across) * weight[x], 6)
    bound = lambda p: np.clip(p, 0, (1 << depth) - 1)
    return {"dc": np.repeat(dc[:, None], AREA * AREA, axis=1), "v": v, "h": h, "paeth": paeth, "smooth": bound(round_(down + across, 1)), "smooth_v": bound(down), "smooth_h": bound(across)}


def _best_plain(depth: int):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        px, above, left = (square(batch.column(c), w) for c, w in (("px", 16), ("above", EDGE), ("left", EDGE)))
        has = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("has_above", "has_left")]
        found = plain_predictions(above, left, batch.column("corner").to_numpy().astype(np.int64), *has, depth)
        sad = np.stack([np.abs(px - p).sum(axis=1) for p in found.values()], axis=1)
        names = np.array(list(found), dtype=object)[sad.argmin(axis=1)]
        return {**{c: batch.column(c) for c in ("frame", "y", "x")}, "mode": pa.array(names, pa.string()), "sad": pa.array(sad.min(axis=1)), "sads": lists(sad)}

    return batches(work)


def best_plain_modes(found: DataFrame, depth: int = 8) -> DataFrame:
    """frame, y, x, mode, sad, sads of areas: the plain prediction of the least sum of absolute differences, the first of equals, and the sums of all seven."""
    return found.mapInArrow(_best_plain(depth), "frame long, y long, x long, mode string, sad long, sads array<long>")


def _best_direction(angles: tuple[int, ...]):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        px, above, left = (square(batch.column(c), w) for c, w in (("px", 16), ("above", EDGE), ("left", EDGE)))
        corner = batch.column("corner").to_numpy().astype(np.int64)
        sad = np.stack([np.abs(px - directional(a, above, left, corner)).sum(axis=1) for a in angles], axis=1)
        best = sad.argmin(axis=1)
        return {**{c: batch.column(c) for c in ("frame", "y", "x")}, "angle": pa.array(np.array(angles)[best]), "sad": pa.array(sad.min(axis=1)), "sads": lists(sad)}

    return batches(work)


def best_directions(found: DataFrame, angles: tuple[int, ...] = ANGLES) -> DataFrame:
    """frame, y, x, angle, sad, sads of areas: the direction of the least sum of absolute differences, the first of equals, and the sums of all."""
    return found.mapInArrow(_best_direction(angles), "frame long, y long, x long, angle long, sad long, sads array<long>")


def _log2(v: np.ndarray) -> np.ndarray:
    """The place of the highest bit, -1 for 0."""
    return np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1


def linear_model(luma: np.ndarray, chroma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shift) of the line chroma = (a * luma >> shift) + b through four pairs (n, 4) of neighbours.

    The line goes through the means of the two pairs of least and of greatest luma; the division is one by table.
    """
    r = np.arange(len(luma))
    low, high = np.tile([0, 2], (len(luma), 1)), np.tile([1, 3], (len(luma), 1))
    for pair in (low, high):
        turn = luma[r, pair[:, 0]] > luma[r, pair[:, 1]]
        pair[turn] = pair[turn][:, ::-1]
    turn = luma[r, low[:, 0]] > luma[r, high[:, 1]]
    low[turn], high[turn] = high[turn], low[turn].copy()
    turn = luma[r, low[:, 1]] > luma[r, high[:, 0]]
    low[turn, 1], high[turn, 0] = high[turn, 0], low[turn, 1].copy()
    mean = lambda v, pair: (v[r, pair[:, 0]] + v[r, pair[:, 1]] + 1) >> 1
    x0, y0, x1, y1 = mean(luma, low), mean(chroma, low), mean(luma, high), mean(chroma, high)
    dx, dy = x1 - x0, y1 - y0
    flat = dx <= 0
    size = _log2(np.maximum(dx, 1))
    part = ((np.maximum(dx, 1) << 4) >> size) & 15
    v = np.array(RECIPROCALS)[part] | 8
    size = size + (part != 0)
    y = _log2(np.abs(dy)) + 1
    a = (dy * v + ((1 << y) >> 1)) >> y
    shift = 3 + size - y
    a = np.where(shift < 1, np.sign(a) * 15, a)
    shift = np.maximum(shift, 1)
    b = y0 - ((a * x0) >> shift)
    return np.where(flat, 0, a), np.where(flat, y0, b), np.where(flat, 0, shift)


def chroma_from_luma(luma: np.ndarray, above: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray], has: tuple[np.ndarray, np.ndarray], depth: int = 8):
    """(prediction, a, b, shift) of 8x8 blocks from the luma and chroma edges (n, 8) above and left, where they are there."""
    n, most = len(luma), (1 << depth) - 1
    both, one = [2, 6], [1, 3, 5, 7]  # the neighbours that are looked at, of two edges and of one
    pairs = []
    for k in (0, 1):
        two = np.concatenate([above[k][:, both], left[k][:, both]], axis=1)
        single = np.where(has[0][:, None], above[k][:, one], left[k][:, one])
        pairs.append(np.where((has[0] & has[1])[:, None], two, single))
    a, b, shift = linear_model(*pairs)
    none = ~(has[0] | has[1])
    a, shift, b = np.where(none, 0, a), np.where(none, 0, shift), np.where(none, 1 << (depth - 1), b)
    return np.clip(((a[:, None] * luma) >> shift[:, None]) + b[:, None], 0, most).reshape(n, -1), a, b, shift


def _predict_chroma(depth: int):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        px, cb = (square(batch.column(c), 64) for c in ("px", "cb"))
        has = [~batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("above_px", "left_px")]

        def edge(name: str, there: np.ndarray) -> np.ndarray:
            out = np.zeros((batch.num_rows, EDGE), np.int64)
            if there.any():
                out[there] = square(batch.column(name).filter(pa.array(there)), EDGE)
            return out

        above, left = ((edge(f"{side}_px", there), edge(f"{side}_cb", there)) for side, there in (("above", has[0]), ("left", has[1])))
        guess, a, b, shift = chroma_from_luma(px, above, left, has, depth)
        return {**{c: batch.column(c) for c in ("frame", "row", "col")}, "a": pa.array(a), "b": pa.array(b), "shift": pa.array(shift), "sad": pa.array(np.abs(guess - cb).sum(axis=1))}

    return batches(work)


def chroma_models(planes: DataFrame, chroma: str = "cb", depth: int = 8) -> DataFrame:
    """frame, row, col, a, b, shift, sad: the linear model of each block's chroma plane and what it misses by.

    planes: frame, row, col, px and a chroma plane of the same size. Samples are looked at in the last row of the block above and
    the last column of the block to the left: two of each, four if only one block is there; a block without either gets the middle value.
    """
    p = planes.select("frame", "row", "col", F.col("px").cast("array<int>").alias("px"), F.col(chroma).cast("array<int>").alias("cb"))
    last_row = lambda c: F.slice(c, 57, 8).alias(c)
    last_col = lambda c: F.array(*(F.col(c)[8 * y + 7] for y in range(8))).alias(c)
    to = lambda kind, dr, dc, px, cb: F.struct(F.lit(kind).alias("kind"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), px, cb)
    sent = F.array(to("own", 0, 0, F.col("px"), F.col("cb")), to("above", 1, 0, last_row("px"), last_row("cb")), to("left", 0, 1, last_col("px"), last_col("cb")))
    m = p.select("frame", F.explode(sent).alias("m")).select("frame", "m.*")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    d = m.groupBy("frame", "row", "col").agg(of("own", "px").alias("px"), of("own", "cb").alias("cb"), *(of(k, c).alias(f"{k}_{c}") for k in ("above", "left") for c in ("px", "cb"))).where("px is not null")
    return d.mapInArrow(_predict_chroma(depth), "frame long, row long, col long, a long, b long, shift long, sad long")
