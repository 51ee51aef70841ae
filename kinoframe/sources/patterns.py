"""Pictures drawn by rule: black, checkers, gradients, blocks of colour, and samples whose low bits are never all zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import dealt

KINDS = ("black", "checker", "gradient", "color_blocks", "bitdepth_canary")
#: Samples of the patterns, Y, U and V. Fixed values.
CHECKER = ((208, 176, 80), (48, 96, 160))
COLOURS = ((32, 128, 128), (80, 96, 176), (144, 176, 96), (224, 112, 144))
CANARY = ((32, 96, 160, 224), (80, 144, 208, 48), (112, 176, 64, 240))


#: Samples that are drawn at once.
CELLS = 1 << 20


def pattern_sample(kind: str, plane: int, x: np.ndarray, y: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The 8-bit samples of a plane at places of frames."""
    if kind == "checker":
        return np.where((x // 8 + y // 8 + frame) % 2 == 0, CHECKER[0][plane], CHECKER[1][plane])
    if kind == "gradient":
        return ((x * 7 + y * 5 + frame * 17), (64 + x * 3 + frame * 11), (96 + y * 4 + frame * 13))[plane] % 256
    if kind == "color_blocks":
        return np.array([c[plane] for c in COLOURS])[(x // 8 + y // 8 * 2 + frame) % 4]
    return np.zeros(len(x), np.int64)


def canary_sample(plane: int, x: np.ndarray, y: np.ndarray, frame: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Samples of more than 8 bits whose low bits tell place, plane and frame, and are all set where they would be zero."""
    low = ((x & 3) | ((y & 3) * 4) | (plane * 2) | frame) & (step - 1)
    return np.array(CANARY[plane])[(x // 8 + y // 8 * 2 + frame) % 4] * step + np.where(low == 0, step - 1, low)


def _samples(kind: str, plane: int, spec: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The samples of planes of one kind, plane by plane, and where each begins."""
    sizes = spec["width"] * spec["height"]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    i = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    width, frame, sx, sy, step = (np.repeat(v, sizes) for v in (spec["width"], spec["frame"], spec["sx"], spec["sy"], 1 << (spec["depth"] - 8)))
    x, y = i % width, i // width
    if kind == KINDS[-1]:
        return canary_sample(plane, x, y, frame, step), ends
    drawn = pattern_sample(kind, plane, x * sx, y * sy, frame)
    for dy, dx in ((0, 1), (1, 0), (1, 1)) if plane else ():
        drawn = drawn + np.where((dx < sx) & (dy < sy), pattern_sample(kind, plane, x * sx + dx, y * sy + dy, frame), 0)
    return drawn // (sx * sy) * step, ends


def _drawn(batches):
    for batch in batches:
        kinds, planes = batch.column("kind").to_numpy(zero_copy_only=False), batch.column("plane").to_numpy()
        spec = {c: batch.column(c).to_numpy().astype(np.int64) for c in ("frame", "width", "height", "sx", "sy", "depth")}
        for kind in KINDS:
            for plane in (0, 1, 2):
                rows = np.flatnonzero((kinds == kind) & (planes == plane))
                cut = np.cumsum(spec["width"][rows] * spec["height"][rows]) // CELLS
                for part in np.split(rows, np.flatnonzero(np.diff(cut)) + 1) if len(rows) else ():
                    px, ends = _samples(kind, plane, {c: v[part] for c, v in spec.items()})
                    at = pa.array(part)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "frame", "plane", "width", "height")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(px))], names=["id", "frame", "plane", "width", "height", "px"])


def pattern_planes(specs: DataFrame) -> DataFrame:
    """id, frame, plane, width, height, px of drawn films: specs (id, kind, width, height, frames, sampling 420, 422 or 444, depth of 8 to 16).

    Chroma of subsampled films is the mean of its two or four places, rounded down; deeper samples are 8-bit ones moved up. The canary is drawn
    plane by plane and needs more than 8 bits. An unknown kind or sampling, a side that is null or below 0, an odd one where chroma is halved, and a
    shallow canary raise.
    """
    halved = F.when(F.col("sampling") == "420", (F.col("width") % 2 != 0) | (F.col("height") % 2 != 0)).otherwise((F.col("sampling") == "422") & (F.col("width") % 2 != 0))
    bad = ~F.col("kind").isin(*KINDS) | ~F.col("sampling").isin("420", "422", "444") | halved | ~F.col("depth").between(8, 16) | ((F.col("kind") == KINDS[-1]) & (F.col("depth") <= 8)) | (F.least("width", "height") < 0) | F.col("width").isNull() | F.col("height").isNull()
    d = specs.withColumn("frames", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("pattern cannot be drawn: "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("frames").cast("long")))
    d = d.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame"))
    planes = []
    for plane in (0, 1, 2):
        sx = F.when((plane > 0) & F.col("sampling").isin("420", "422"), 2).otherwise(1).cast("long")
        sy = F.when((plane > 0) & (F.col("sampling") == "420"), 2).otherwise(1).cast("long")
        planes.append(F.struct(F.lit(plane).alias("plane"), F.floor(F.col("width") / sx).alias("w"), F.floor(F.col("height") / sy).alias("h"), sx.alias("sx"), sy.alias("sy")))
    d = d.select("id", "kind", "depth", "frame", F.explode(F.array(*planes)).alias("p")).select("id", "kind", "depth", "frame", "p.*")
    # films are dealt over all tasks frame by frame, as their specs are few bytes; none holds more than one plane and the samples drawn at once
    d = dealt(d, "id", "frame").select("id", "frame", "plane", F.col("w").alias("width"), F.col("h").alias("height"), "kind", F.col("depth").cast("long").alias("depth"), "sx", "sy")
    return d.mapInArrow(_drawn, f"id {specs.schema['id'].dataType.simpleString()}, frame long, plane int, width long, height long, px array<long>")
