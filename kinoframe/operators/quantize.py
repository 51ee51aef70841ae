"""Quantizers of 4x4 transforms and of plain residuals, pruned candidates, and the choice among them by rate and distortion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import batches, forward_dct, inverse_dct, lists, quarters, square

#: Steps of the quantizer indices 0 to 24, in eighths; each 24 further the step doubles. Fixed values.
STEPS = (64, 40, 41, 43, 44, 45, 47, 48, 49, 51, 52, 54, 55, 57, 59, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78)
#: Highest quantizer index by depth, and the bits of a step, of its reciprocal and of the product. Fixed values.
LAST_INDEX = {8: 255, 10: 303, 12: 351}
STEP_BITS, RECIPROCAL_BITS, PRODUCT_BITS = 3, 23, 20
#: The order in which the coefficients of a 4x4 area are scanned. Fixed values.
SCAN = (0, 4, 1, 8, 5, 2, 12, 9, 6, 3, 13, 10, 7, 14, 11, 15)
#: Weight of lost variance beside an error, and the share of a step's square that an error may have, in ninths. Fixed values.
VARIANCE_WEIGHT, SHARE = 2, 9
#: Scales of plain residuals by quantizer modulo 6. Fixed values.
SKIP_SCALES = (40, 45, 51, 57, 64, 72)
#: Indices from which levels are pruned and pruned more, and the variance up to which they are at 8 bits. Fixed values.
CALM_INDEX, COARSE_INDEX, CALM = 72, 160, 16384
CHOICES = ("whole", "no_units", "no_small", "dc_only")


def step_of(index: int, depth: int = 8) -> int:
    """The step of a quantizer index, in eighths."""
    index = min(max(index, 1), LAST_INDEX[depth])
    return STEPS[index] if index < 25 else STEPS[(index - 1) % 24 + 1] << ((index - 1) // 24)


def step_column(index: Column, depth: int = 8) -> Column:
    """step_of as a column."""
    i = F.least(F.greatest(index.cast("long"), F.lit(1)), F.lit(LAST_INDEX[depth]))
    table = F.array(*(F.lit(s).cast("long") for s in STEPS))
    far = F.get(table, ((i - 1) % 24 + 1).cast("int")) * F.pow(F.lit(2), F.floor((i - 1) / 24)).cast("long")
    return F.when(i < 25, F.get(table, i.cast("int"))).otherwise(far)


def quantized(c: np.ndarray, step: int) -> np.ndarray:
    """Levels of coefficients: what is below a sixteenth of a step is nothing, the rest is rounded up from 15/16."""
    size = np.abs(c)
    level = ((size + (64 * step >> (7 + STEP_BITS))) * ((1 << RECIPROCAL_BITS) // step)) >> PRODUCT_BITS
    return np.where(size << (1 + STEP_BITS) >= step, level, 0) * np.sign(c)


def restored(level: np.ndarray, step: int) -> np.ndarray:
    return ((np.abs(level) * step + (1 << (STEP_BITS - 1))) >> STEP_BITS) * np.sign(level)


def small_limit(index: int, depth: int, full_chroma: bool, spread: np.ndarray) -> np.ndarray:
    """The largest level that is small: at 8 bits 1 for 4:4:4 films from index 72 on where the variance is low, deeper 3 from 72 and 4 from 160 on, else 0."""
    if depth > 8:
        return np.full(len(spread), 0 if index < CALM_INDEX else 3 if index < COARSE_INDEX else 4)
    return np.where((spread <= CALM) & (index >= CALM_INDEX) & full_chroma, 1, 0)


def without_small(level: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Levels (n, 16) with all but the first at 0 that are no larger than `most` (of each row, or of all)."""
    out = np.where(np.abs(level) <= np.reshape(most, (-1, 1)), 0, level)
    out[:, 0] = level[:, 0]
    return out


def without_last_units(level: np.ndarray, most: int) -> np.ndarray:
    """Levels (n, 16) without their last 1s and -1s in scan order, `most` at the most, up to the first larger one; the first level stays."""
    out = level.copy()
    live, gone = np.ones(len(level), bool), np.zeros(len(level), np.int64)
    for at in reversed(SCAN[1:]):
        size = np.abs(out[:, at])
        live &= (size <= 1) & (gone < most)
        unit = live & (size == 1)
        out[unit, at] = 0
        gone += unit
    return out


def variance(x: np.ndarray) -> np.ndarray:
    """Sum of squares around the mean of each row, the square of the mean rounded to the nearest."""
    n = x.shape[1]
    s = x.sum(axis=1)
    return np.maximum((x * x).sum(axis=1) - (s * s + n // 2) // n, 0)


def level_bits(level: np.ndarray) -> np.ndarray:
    """Bits of the levels of each row by signed exponential Golomb codes."""
    code = 2 * np.abs(level) + (level <= 0)
    return (2 * np.floor(np.log2(code)).astype(np.int64) + 1).sum(axis=1)


def choices(x: np.ndarray, step: int, depth: int = 8, units: int = 4, small: int | np.ndarray = 1) -> dict[str, np.ndarray]:
    """For residuals (n, 16): the choice, its score, bits, error and levels.

    Candidates are all levels, those without the last units, without small ones, and the first level alone. A candidate's score is its bits and
    its error, with twice the variance it loses, over the step; one whose error is beyond SHARE of the step's square a sample is out, but
    for the first. A later candidate needs a smaller score.
    """
    whole = quantized(forward_dct(x.reshape(-1, 4, 4)).reshape(-1, 16), step)
    first = np.zeros_like(whole)
    first[:, 0] = whole[:, 0]
    candidates = [whole, without_last_units(whole, units), without_small(whole, small), first]
    plain = max(step >> STEP_BITS, 1)
    most, before = plain * plain * 16 // SHARE, variance(x)
    best = None
    for k, level in enumerate(candidates):
        back = inverse_dct(restored(level, step).reshape(-1, 4, 4), depth).reshape(-1, 16)
        sse = ((x - back) ** 2).sum(axis=1)
        bits = level_bits(level)
        score = bits + (sse + VARIANCE_WEIGHT * np.maximum(before - variance(back), 0)) // plain
        here = {"choice": np.full(len(x), k), "score": score, "bits": bits, "sse": sse, "levels": level}
        if best is None:
            best = here
            continue
        better = (sse <= most) & (score < best["score"])
        best = {name: np.where(better[:, None] if v.ndim == 2 else better, here[name], v) for name, v in best.items()}
    return best


def _choose(index: int, depth: int):
    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = quarters(square(batch.column("px"), 64) - (1 << (depth - 1))).reshape(-1, 16)
        got = choices(x, step_of(index, depth), depth, small=small_limit(index, depth, True, variance(x)))
        ids = np.repeat(batch.column("block_id").to_numpy(), 4)
        names = np.array(CHOICES, dtype=object)[got["choice"]]
        return {"block_id": pa.array(ids), "quarter": pa.array(np.tile(np.arange(4), batch.num_rows)), "choice": pa.array(names, pa.string()), **{c: pa.array(got[c]) for c in ("score", "bits", "sse")}, "levels": lists(got["levels"])}

    return batches(work)


def transform_choices(blocks: DataFrame, index: int, depth: int = 8) -> DataFrame:
    """A row a 4x4 quarter: block_id, quarter, choice, score, bits, sse, levels at a quantizer index, of the samples less the middle value."""
    return blocks.select("block_id", F.col("px").cast("array<int>").alias("px")).mapInArrow(_choose(index, depth), "block_id long, quarter long, choice string, score long, bits long, sse long, levels array<long>")


def skip_restored(level: Column, qp: int, depth: int = 8) -> Column:
    """The residual of a level without a transform, within 16 bits."""
    q = max(qp + (depth - 8) * 6, 4)
    scale, shift = SKIP_SCALES[q % 6], 6 - q // 6
    value = F.floor((level * scale + (1 << (shift - 1))) / (1 << shift)) if shift > 0 else level * (scale << -shift)
    return F.when(level == 0, 0).otherwise(F.greatest(F.least(value, F.lit(32767)), F.lit(-32768))).cast("long")


def skip_level(residual: Column, qp: int, depth: int = 8) -> Column:
    """The level whose residual is nearest, of the estimate and two on each side; of equals the smaller one, then the first."""
    q = max(qp + (depth - 8) * 6, 4)
    scale, shift = SKIP_SCALES[q % 6], 6 - q // 6
    size, over = (F.abs(residual) * (1 << shift), scale) if shift > 0 else (F.abs(residual), scale << -shift)
    estimate = F.signum(residual).cast("long") * F.floor((size + over // 2) / over)
    bound = lambda v: F.greatest(F.least(v, F.lit(32767)), F.lit(-32768))
    near = F.array(*(F.lit(k).cast("long") for k in (0, -2, -1, 1, 2)))

    def one(e: Column, k: Column, i: Column) -> Column:
        level = bound(e + k)
        miss = residual - skip_restored(level, qp, depth)
        return F.struct((miss * miss).alias("error"), F.abs(level).alias("size"), i.alias("i"), level.alias("level"))

    best = F.transform(F.array(estimate), lambda e: F.array_min(F.transform(near, lambda k, i: one(e, k, i))))[0]["level"]
    return F.when(residual == 0, 0).otherwise(best).cast("long")


def skip_blocks(blocks: DataFrame, qp: int, depth: int = 8) -> DataFrame:
    """block_id, levels, sse: the samples less the middle value, quantized without a transform."""
    d = blocks.select("block_id", F.transform("px", lambda v: v.cast("long") - (1 << (depth - 1))).alias("r"))
    d = d.withColumn("levels", F.transform("r", lambda r: skip_level(r, qp, depth)))
    miss = F.zip_with("r", "levels", lambda r, v: (r - skip_restored(v, qp, depth)) * (r - skip_restored(v, qp, depth)))
    return d.select("block_id", "levels", F.aggregate(miss, F.lit(0).cast("long"), lambda a, v: a + v).alias("sse"))
