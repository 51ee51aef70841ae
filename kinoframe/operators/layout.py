"""Where blocks and tiles lie: uniform tiles, search masks, merged leaves, leaf order; block hashes, smooth predictors, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, FRAME_BLOCKS, SUPERBLOCK = 8, 64, 64
#: Seed and 32-bit mask of the shift hash. Fixed values.
HASH_SEED, WORD_MASK = 0x811C9DC5, 0xFFFFFFFF
#: Weights of a smooth predictor by distance from the edge, of 64. Fixed values.
EDGE_WEIGHTS = (32, 8, 2, 0)
AREA = 4
#: Limits of tiles at level 2.0, in superblocks: width, area, and tiles along a side. Fixed values.
MOST_WIDTH, MOST_AREA, MOST_TILES = 64, 2304, 64


def shift_hash(px: Column) -> Column:
    """A 32-bit hash of 8-bit samples in order, by exclusive or and three shifts a sample."""

    def step(h: Column, v: Column) -> Column:
        h = h.bitwiseXOR(v.cast("long"))
        h = h.bitwiseXOR(F.shiftleft(h, 13).bitwiseAND(F.lit(WORD_MASK)))
        h = h.bitwiseXOR(F.shiftright(h, 17))
        return h.bitwiseXOR(F.shiftleft(h, 5).bitwiseAND(F.lit(WORD_MASK)))

    return F.aggregate(px, F.lit(HASH_SEED).cast("long"), step)


def packet_hash(planes: list[Column], bytes_a_sample: int = 1) -> Column:
    """A 32-bit hash of an 8x8 block of full-size planes: one round a packet of eight bytes, with its plane and place mixed in.

    px columns are arrays of 64 samples; samples of two bytes are little-endian, so a row is two packets.
    """
    turned = lambda v, k: F.shiftleft(v, k).bitwiseAND(F.lit(WORD_MASK)).bitwiseOR(F.shiftrightunsigned(v, 32 - k))
    packets = []
    for plane, px in enumerate(planes):
        for y in range(SIDE):
            row = [px[SIDE * y + x].cast("long") for x in range(SIDE)]
            if bytes_a_sample == 2:
                row = [b for v in row for b in (v % 256, F.floor(v / 256))]
            for k in range(bytes_a_sample):
                eight = row[8 * k : 8 * k + 8]
                word = lambda part: sum((v * (1 << 8 * i) for i, v in enumerate(part[1:], 1)), part[0])
                meta = plane << 10 | (y * SIDE * bytes_a_sample + 8 * k) << 4 | 8
                packets.append(F.struct(word(eight[:4]).alias("low"), word(eight[4:]).alias("high"), F.lit(meta).cast("long").alias("meta")))

    def step(h: Column, p: Column) -> Column:
        mixed = h.bitwiseXOR(p["low"]).bitwiseXOR(turned(p["high"], 5)).bitwiseXOR(p["meta"])
        spread = lambda r: r.bitwiseXOR(turned(r, 13)).bitwiseXOR(F.shiftleft(r, 7).bitwiseAND(F.lit(WORD_MASK))).bitwiseXOR(F.shiftrightunsigned(r, 11))
        return F.transform(F.array(mixed), spread)[0]

    return F.aggregate(F.array(*packets), F.lit(HASH_SEED).cast("long"), step)


def placed(blocks: DataFrame) -> DataFrame:
    """block_id, frame, row and col of each block (frames of 8 by 8 blocks), and its samples."""
    at = F.pmod("block_id", F.lit(FRAME_BLOCKS))
    return blocks.select("block_id", F.floor(F.col("block_id") / FRAME_BLOCKS).alias("frame"), F.floor(at / SIDE).alias("row"), F.pmod(at, F.lit(SIDE)).alias("col"), "px")


def leaf_order(blocks: DataFrame) -> DataFrame:
    """(block_id, frame, z): the place of each block in the depth-first order of a full superblock, row and column bits in turn."""
    bit = lambda v, k: F.shiftright(F.col(v), k).bitwiseAND(F.lit(1))
    z = sum((bit("col", k) * 4**k + bit("row", k) * 2 * 4**k for k in range(3)), F.lit(0))
    return placed(blocks).select("block_id", "frame", z.cast("long").alias("z"))


def merged_leaves(modes: DataFrame, side: int) -> DataFrame:
    """A row a leaf of side x side blocks: its mode where all its blocks lie in the frame and share one, else null.

    modes: frame, row, col, mode. A mode that is null shares with nothing.
    """
    leaf = [F.floor(F.col(c) / side).alias(f"leaf_{c}") for c in ("row", "col")]
    whole = (F.count("mode") == side * side) & (F.min("mode") == F.max("mode"))
    return modes.groupBy("frame", *leaf).agg(F.when(whole, F.min("mode")).alias("mode"))


def search_mask(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """For each frame: its regions, those that leave the frame or the grid, and how many blocks are searched.

    regions: frame, x0, y0, width, height in samples. Valid regions are cut into blocks, so the join is one on block
    places; a frame without any region is searched whole, a bad or an empty region covers nothing.
    """
    edge, sides = SIDE * SIDE, ("x0", "y0", "width", "height")
    grid = [F.col(c) % SIDE == 0 for c in sides]
    empty = (F.col("width") == 0) | (F.col("height") == 0)
    good = grid[0] & grid[1] & grid[2] & grid[3] & (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + F.col("width") <= edge) & (F.col("y0") + F.col("height") <= edge)
    r = regions.withColumn("good", empty | F.coalesce(good, F.lit(False))).withColumn("empty", empty)
    steps = lambda low, size: F.sequence(F.floor(F.col(low) / SIDE), F.floor((F.col(low) + F.col(size)) / SIDE) - 1)
    cells = r.where("good and not empty").select("frame", F.explode(steps("y0", "height")).alias("row"), "x0", "width").select("frame", "row", F.explode(steps("x0", "width")).alias("col"))
    covered = placed(blocks).select("frame", "row", "col").join(cells, ["frame", "row", "col"], "left_semi").groupBy("frame").agg(F.count("*").alias("covered"))
    per = r.groupBy("frame").agg(F.count("*").alias("n_regions"), F.count_if(~F.col("good")).alias("n_bad"))
    d = placed(blocks).groupBy("frame").agg(F.count("*").alias("n_blocks")).join(per, "frame", "left").join(covered, "frame", "left")
    searched = F.when(F.col("n_regions").isNull(), F.col("n_blocks")).otherwise(F.coalesce("covered", F.lit(0)))
    return d.select("frame", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), searched.alias("searched"))


def tile_starts(size: Column, log2: Column) -> Column:
    """array<struct<at, start, stop>> of the uniform tiles along one side, in superblocks: larger ones first, a partial superblock in the last."""
    n, full = F.ceil(size / SUPERBLOCK), F.floor(F.ceil(size / 8) * 8 / SUPERBLOCK)
    base = F.floor(full / F.pow(F.lit(2), log2)).cast("long")
    extra = F.when(base == 0, n).otherwise(full - base * F.pow(F.lit(2), log2).cast("long"))
    start = lambda i: F.least(i * base + F.least(i, extra), n)
    many = F.pow(F.lit(2), log2).cast("long")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda i: F.struct(i.alias("at"), start(i).alias("start"), F.when(i == many - 1, n).otherwise(start(i + 1)).alias("stop")))
    return F.filter(tiles, lambda t: t["start"] < t["stop"])


def tile_log2(size: int, target: Column) -> Column:
    """The least k for which size * 2^k reaches the target."""
    return F.when(target <= size, 0).otherwise(F.length(F.bin(F.floor((target - 1) / size)))).cast("long")


def tile_limits(pictures: DataFrame) -> DataFrame:
    """pictures (id, width, height) with the limits of uniform tiles at level 2.0: min_log2_cols, max_log2_cols, max_log2_rows, min_log2 (of both)."""
    sbs = lambda c: F.ceil(F.ceil(F.col(c) / 8) * 8 / SUPERBLOCK)
    d = pictures.withColumns({"_c": sbs("width"), "_r": sbs("height")})
    d = d.withColumns({"min_log2_cols": tile_log2(MOST_WIDTH, F.col("_c")), "max_log2_cols": tile_log2(1, F.least("_c", F.lit(MOST_TILES))), "max_log2_rows": tile_log2(1, F.least("_r", F.lit(MOST_TILES)))})
    return d.withColumn("min_log2", F.greatest(tile_log2(MOST_AREA, F.col("_c") * F.col("_r")), "min_log2_cols")).drop("_c", "_r")


def fast_tiles(pictures: DataFrame) -> DataFrame:
    """pictures (id, width, height) with log2_cols and log2_rows: four columns from 1920 samples on, two from 1024, two rows from 1080, within the limits."""
    d = tile_limits(pictures)
    wide = F.when(F.col("width") >= 1920, 2).when(F.col("width") >= 1024, 1).otherwise(0)
    d = d.withColumn("log2_cols", F.least(F.greatest(wide, "min_log2_cols"), "max_log2_cols").cast("long"))
    rows = F.greatest(F.when(F.col("height") >= 1080, 1).otherwise(0), F.greatest(F.col("min_log2") - F.col("log2_cols"), F.lit(0)))
    return d.withColumn("log2_rows", F.least(rows, "max_log2_rows").cast("long"))


def checked_tiles(pictures: DataFrame) -> DataFrame:
    """pictures (id, width, height, log2_cols, log2_rows) as they are; a choice beyond the limits raises."""
    d = tile_limits(pictures)
    good = (F.col("log2_cols") >= F.col("min_log2_cols")) & (F.col("log2_cols") <= F.col("max_log2_cols")) & (F.col("log2_rows") <= F.col("max_log2_rows")) & (F.col("log2_cols") + F.col("log2_rows") >= F.col("min_log2"))
    bad = F.raise_error(F.concat(F.lit("tiles beyond the limits of picture "), F.col("id").cast("string"))).cast("long")
    return d.withColumn("log2_cols", F.when(good, F.col("log2_cols")).otherwise(bad)).select(*pictures.columns)


def tile_layout(pictures: DataFrame) -> DataFrame:
    """A row a tile: id, tile_row, tile_col, x, y, width, height in samples; pictures: id, width, height, log2_cols, log2_rows."""
    d = pictures.select("id", "width", "height", F.explode(tile_starts(F.col("width"), F.col("log2_cols"))).alias("c"), tile_starts(F.col("height"), F.col("log2_rows")).alias("r"))
    d = d.select("id", "width", "height", "c", F.explode("r").alias("r"))
    low = lambda t: F.col(f"{t}.start") * SUPERBLOCK
    span = lambda t, size: F.least(F.col(f"{t}.stop") * SUPERBLOCK, F.col(size)) - low(t)
    return d.select("id", F.col("r.at").alias("tile_row"), F.col("c.at").alias("tile_col"), low("c").alias("x"), low("r").alias("y"), span("c", "width").alias("width"), span("r", "height").alias("height"))


def rounded(v: Column, bits: int) -> Column:
    return F.floor((v + 2 ** (bits - 1)) / 2**bits)


def smooth_errors(blocks: DataFrame) -> DataFrame:
    """For each block: absolute differences of the three smooth predictors over the 4x4 area one sample in from its corner.

    A line is drawn from the edge sample to the far corner of the other edge, then pulled to the edge near it; the
    plain mode is the mean of both directions. The best mode is the least sum, in the order smooth, vertical, horizontal.
    """
    px = lambda row, col: F.get("px", (row * SIDE + col).cast("int")).cast("long")
    weight = lambda i: F.get(F.array(*map(F.lit, EDGE_WEIGHTS)), i.cast("int"))

    def along(edge: Column, far: Column, i: Column) -> Column:
        line = far + rounded((edge - far) * (AREA - 1 - i), 2)
        return F.transform(F.array(line), lambda p: p + rounded((edge - p) * weight(i), 6))[0]

    def at(k: Column) -> Column:
        y, x = F.floor(k / AREA), F.pmod(k, F.lit(AREA))
        v = along(px(F.lit(0), x + 1), px(F.lit(AREA + 1), F.lit(0)), y)
        h = along(px(y + 1, F.lit(0)), px(F.lit(0), F.lit(AREA + 1)), x)
        return F.struct(px(y + 1, x + 1).alias("s"), v.alias("v"), h.alias("h"))

    bound = lambda p: F.greatest(F.least(p, F.lit(255)), F.lit(0))
    d = blocks.select("block_id", F.transform(F.sequence(F.lit(0), F.lit(AREA * AREA - 1)), at).alias("area"))
    off = lambda use: F.aggregate("area", F.lit(0).cast("long"), lambda a, t: a + F.abs(t["s"] - bound(use(t))))
    d = d.select("block_id", off(lambda t: rounded(t["v"] + t["h"], 1)).alias("smooth"), off(lambda t: t["v"]).alias("vertical"), off(lambda t: t["h"]).alias("horizontal"))
    least = F.least("smooth", "vertical", "horizontal")
    return d.withColumn("best", F.when(F.col("smooth") == least, "smooth").when(F.col("vertical") == least, "vertical").otherwise("horizontal"))


def dominating(candidates: Column) -> Column:
    """Of (at, rate, distortion) in order: each takes the place of the best so far only if it is no worse in either and better in one."""

    def better(best: Column, c: Column) -> Column:
        no_worse = (c["rate"] <= best["rate"]) & (c["distortion"] <= best["distortion"])
        return F.when(no_worse & ((c["rate"] < best["rate"]) | (c["distortion"] < best["distortion"])), c).otherwise(best)

    return F.aggregate(candidates, candidates[0], better)


def step_choice(blocks: DataFrame, steps: tuple[int, ...]) -> DataFrame:
    """block_id and the chosen step of the given ones, with its rate (distinct levels) and distortion (squares of what is cut off)."""

    def candidate(s: int) -> Column:
        levels = F.array_distinct(F.transform("px", lambda v: F.floor(v / s)))
        lost = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + (v % s) * (v % s))
        return F.struct(F.lit(s).cast("long").alias("at"), F.size(levels).cast("long").alias("rate"), lost.alias("distortion"))

    d = blocks.select("block_id", F.array(*map(candidate, steps)).alias("c")).select("block_id", dominating(F.col("c")).alias("b"))
    return d.select("block_id", F.col("b.at").alias("step"), F.col("b.rate").alias("rate"), F.col("b.distortion").alias("distortion"))


def smallest_payload(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the payload of least size, then fewest symbol bits, then first name; payloads: keys, name, size, symbols."""
    return payloads.groupBy(*keys).agg(F.min(F.struct("size", "symbols", "name")).alias("p"), F.count("*").alias("n_payloads")).select(*keys, "n_payloads", "p.name", "p.size", "p.symbols")
