"""Blocks that are copies: of the picture before (in place, by a neighbour's vector, near by, anywhere) and of the same picture.

Blocks are rows (frame, row, col, px); px may hold the samples of all planes, one after the other. Samples are
compared, never hashes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import dealt

#: Block steps of the local search, and its directions (rows, columns) in order. Fixed values.
NEAR = (1, 2, 4, 8)
DIRECTIONS = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Equal blocks of the picture before beyond which the search anywhere gives up. Fixed value.
MOST_EQUAL = 8
#: Blocks on a side of a superblock, and superblocks to the left that a copy inside a picture may reach. Fixed values.
SUPERBLOCK, REACH = 8, 4
LAST = 5
#: Pictures of a range that is looked through together.
RUN = 4096
#: A place as one number: rows times this, and the column. Fixed value.
LINE = 1 << 32
#: Steps that a block tries in the picture before, in order, and pairs of places that are compared at once. Fixed values.
STEPS = ((0, 0), *((s * r, s * c) for s in NEAR for r, c in DIRECTIONS))
PAIRS = 1 << 20
#: Pictures of a run that one task codes, after the one before the run, and pictures whose waves are decided at once. Fixed values.
CODED, TOGETHER = 16, 32


def _nearest(y, x, begin, n, ref_y, ref_x):
    """The vector (rows, columns) from each place to the nearest of its n references from begin on: rows plus columns, then the lower row and column."""
    r, c = np.zeros((2, len(y)), np.int64)
    left = np.flatnonzero(n)
    for part in np.split(left, np.flatnonzero(np.diff(np.cumsum(n[left]) // PAIRS)) + 1) if len(left) else ():
        ends, i = np.cumsum(n[part]), np.repeat(np.arange(len(part)), n[part])
        j = np.arange(len(i)) - (ends - n[part] - begin[part])[i]
        dy, dx = ref_y[j] - y[part][i], ref_x[j] - x[part][i]
        best = np.lexsort((dx, dy, np.abs(dy) + np.abs(dx), i))[ends - n[part]]
        r[part], c[part] = dy[best], dx[best]
    return r, c


def _stepped(batches):
    """Rows (frame, now, was), the places of equal blocks in two pictures: at, k, r, c of the step (len(STEPS): none) and the vector of each place in now."""
    for batch in batches:
        lists = [batch.column(c) for c in ("now", "was")]
        sizes = [np.diff(x.offsets.to_numpy()) for x in lists]
        at, ref = (x.flatten().to_numpy() for x in lists)
        row, ref_row = (np.repeat(np.arange(batch.num_rows), n) for n in sizes)
        (y, x), (ref_y, ref_x) = ((v >> 32, v & (LINE - 1)) for v in (at, ref))
        far = NEAR[-1]
        height, width = (int(max(a.max(initial=0), b.max(initial=0))) + 2 * far + 1 for a, b in ((y, ref_y), (x, ref_x)))
        key = lambda g, v, u, h=height, w=width: (g * h + v + far) * w + u + far
        known = np.sort(key(ref_row, ref_y, ref_x))
        k, r, c = (np.full(len(at), v, np.int64) for v in (len(STEPS), 0, 0))
        left = np.arange(len(at))
        for step, (dy, dx) in enumerate(STEPS):
            want = key(row[left], y[left] + dy, x[left] + dx)
            hit = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want if len(known) else np.zeros(len(left), bool)
            k[left[hit]], r[left[hit]], c[left[hit]] = step, dy, dx
            left = left[~hit]
        begin = np.cumsum(sizes[1]) - sizes[1]
        r[left], c[left] = _nearest(y[left], x[left], begin[row[left]], sizes[1][row[left]], ref_y, ref_x)
        yield pa.RecordBatch.from_arrays([batch.column("frame").take(pa.array(row)), pa.array(at), pa.array(k, pa.int32()), pa.array(r), pa.array(c)], names=["frame", "at", "k", "r", "c"])


def motion_cascade(blocks: DataFrame) -> DataFrame:
    """Each block with an equal one in the picture before: frame, row, col, source, mv_row, mv_col, in blocks.

    The first that is equal counts: in place, then 1, 2, 4 and 8 blocks off in eight directions, then the nearest anywhere (rows
    plus columns, then the lower row and column), with no bound on equal blocks. Samples are sent twice, to find which blocks
    of two pictures are equal; from then on a row is a list of places in each, and a step is tried for all places of a batch at once.
    """
    place, none = F.col("row").cast("long") * LINE + F.col("col"), F.lit(None).cast("long")
    known = blocks.where("px is not null")
    both = known.select("frame", "px", place.alias("now"), none.alias("was")).union(known.select((F.col("frame") + 1).alias("frame"), "px", none, place))
    equal = both.groupBy("frame", "px").agg(F.collect_list("now").alias("now"), F.collect_list("was").alias("was")).where((F.size("now") > 0) & (F.size("was") > 0)).drop("px")
    d = equal.select(F.col("frame").cast("long").alias("frame"), "now", "was").mapInArrow(_stepped, "frame long, at long, k int, r long, c long")
    source = F.when(F.col("k") == 0, "in place").when(F.col("k") < len(STEPS), "near").otherwise("anywhere")
    like = lambda v, c: v.cast(blocks.schema[c].dataType).alias(c)
    return d.select(like(F.col("frame"), "frame"), like(F.shiftright("at", 32), "row"), like(F.col("at").bitwiseAND(F.lit(LINE - 1)), "col"), source.alias("source"), F.col("r").alias("mv_row"), F.col("c").alias("mv_col"))


def vectors(now: np.ndarray, before: np.ndarray, most_equal: int | None = MOST_EQUAL) -> tuple[np.ndarray, np.ndarray]:
    """(source, mv) of the blocks of a picture, given as grids of codes (equal blocks have equal codes, -1 is no block), or of a stack of pictures.

    source: 0 zero, 1 neighbour, 2 local, 3 index, -1 none. A block tries no motion; the vectors of the blocks left, above,
    above left and above right; eight directions by 1, 2, 4, 8 blocks around each of these; and the index of all blocks, if
    no more than most_equal are its equals. From the first block in raster order that all but the index
    fail, the index is asked before the local search. A block waits for the four blocks only, so a wave of blocks with
    the same 2 * row + col is decided at once, in all pictures.
    """
    shape = now.shape
    now, before = (a.reshape(-1, *shape[-2:]) for a in (now, before))
    source, mv = _waves(now, before, most_equal, np.zeros(now.shape, bool))
    failed = (((source == 3) | (source == -1)) & (now >= 0)).reshape(len(now), -1)
    again = np.flatnonzero(failed.any(axis=1))
    if len(again):
        asked = np.arange(failed.shape[1]) > failed[again].argmax(axis=1)[:, None]
        source[again], mv[again] = _waves(now[again], before[again], most_equal, asked.reshape(-1, *shape[-2:]))
    return source.reshape(shape), mv.reshape(*shape, 2)


def _waves(now, before, most_equal, asked):
    pictures, rows, cols = now.shape
    source, mv = np.full(now.shape, -1, np.int8), np.zeros((*now.shape, 2), np.int64)
    local = np.array([(s * r, s * c) for s in NEAR for r, c in DIRECTIONS])
    codes = int(max(now.max(initial=0), before.max(initial=0))) + 1
    ref_g, ref_y, ref_x = np.nonzero(before >= 0)
    places = ref_g * codes + before[ref_g, ref_y, ref_x]
    order = np.argsort(places, kind="stable")
    places, ref_y, ref_x = places[order], ref_y[order], ref_x[order]

    def hits(g, r, c, v):
        """Which of the vectors v (blocks, vectors, 2) lead to an equal block."""
        y, x = r[:, None] + v[..., 0], c[:, None] + v[..., 1]
        inside = (y >= 0) & (y < rows) & (x >= 0) & (x < cols)
        return inside & (before[g[:, None], np.clip(y, 0, rows - 1), np.clip(x, 0, cols - 1)] == now[g, r, c][:, None])

    def indexed(g, r, c):
        """Decide the blocks that the index has an answer for; which ones."""
        want = g * codes + now[g, r, c]
        begin = np.searchsorted(places, want)
        n = np.searchsorted(places, want, "right") - begin
        if most_equal is not None:
            n[n > most_equal] = 0
        found = n > 0
        g, r, c = g[found], r[found], c[found]
        source[g, r, c] = 3
        mv[g, r, c] = np.stack(_nearest(r, c, begin[found], n[found], ref_y, ref_x), axis=1)
        return found

    for wave in range(cols + 2 * (rows - 1)):
        r = np.arange(max(0, -(-(wave - cols + 1) // 2)), min(rows - 1, wave // 2) + 1)
        g, r = np.repeat(np.arange(pictures), len(r)), np.tile(r, pictures)
        c = wave - 2 * r
        live = now[g, r, c] >= 0
        g, r, c = g[live], r[live], c[live]
        if not len(r):
            continue
        candidates, known = [np.zeros((len(r), 2), np.int64)], [np.ones(len(r), bool)]
        for dr, dc in ((0, -1), (-1, 0), (-1, -1), (-1, 1)):
            y, x = r + dr, c + dc
            inside = (y >= 0) & (x >= 0) & (x < cols)
            y, x = np.clip(y, 0, rows - 1), np.clip(x, 0, cols - 1)
            candidates.append(mv[g, y, x])
            known.append(inside & (source[g, y, x] >= 0))
        v, known = np.stack(candidates, axis=1), np.stack(known, axis=1)
        ok = hits(g, r, c, v) & known
        at, got = ok.argmax(axis=1), ok.any(axis=1)
        source[g[got], r[got], c[got]] = np.where(at[got] == 0, 0, 1)
        mv[g[got], r[got], c[got]] = v[got, at[got]]
        first = np.flatnonzero(~got & asked[g, r, c])
        got[first] = indexed(g[first], r[first], c[first])
        left = np.flatnonzero(~got)
        if len(left):
            around = (v[left][:, :, None, :] + local).reshape(len(left), -1, 2)
            ok = hits(g[left], r[left], c[left], around) & np.repeat(known[left], len(local), axis=1)
            at, near = ok.argmax(axis=1), ok.any(axis=1)
            hit, left = left[near], left[~near]
            source[g[hit], r[hit], c[hit]] = 2
            mv[g[hit], r[hit], c[hit]] = around[near, at[near]]
            indexed(g[left], r[left], c[left])
    return source, mv


SOURCES = ("zero", "neighbour", "local", "index")


def _coded(batches):
    """(run, frame, row, col, code) of each picture of rows by run and frame; equal samples have equal codes in a picture and the one before it."""
    at, known, before, numbers, parts = None, {}, {}, itertools.count(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        run, frame, row, col = (batch.column(c).to_numpy() for c in ("run", "frame", "row", "col"))
        px = batch.column("px")
        ends, samples = px.offsets.to_numpy(), np.ascontiguousarray(px.flatten().to_numpy(zero_copy_only=False), np.int32)
        ends = (4 * (ends - ends[0])).astype(np.int64)
        samples = pa.Array.from_buffers(pa.large_binary(), len(px), [None, pa.py_buffer(ends), pa.py_buffer(samples)])
        cuts = np.flatnonzero((np.diff(frame) != 0) | (np.diff(run) != 0)) + 1
        for low, high in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if (run[low], frame[low]) != at:
                if parts:
                    yield *at, *map(np.concatenate, zip(*parts, strict=True))
                at, before, known, parts = (run[low], frame[low]), known, {}, []
            seen = samples.slice(low, high - low).dictionary_encode()
            codes = []
            for v in seen.dictionary.to_pylist():
                if v not in known:
                    known[v] = before[v] if v in before else next(numbers)
                codes.append(known[v])
            parts.append((row[low:high], col[low:high], np.array(codes, np.int64)[seen.indices.to_numpy()]))
    if parts:
        yield *at, *map(np.concatenate, zip(*parts, strict=True))


def _decided(held, most_equal):
    """The vectors of pictures (frame, places and codes, places and codes of the one before it)."""
    frame, now, was = zip(*held, strict=True)
    rows, cols = (max(int(p[k].max()) for p in (*now, *was) if len(p[k])) + 1 for k in (0, 1))
    grids = []
    for pictures in (now, was):
        grid = np.full((len(held), rows, cols), -1)
        g, (r, c, code) = np.repeat(np.arange(len(held)), [len(p[0]) for p in pictures]), map(np.concatenate, zip(*pictures, strict=True))
        grid[g, r, c] = code
        grids.append((grid, g, r, c))
    source, mv = vectors(grids[0][0], grids[1][0], most_equal)
    g, r, c = grids[0][1:]
    s = source[g, r, c]
    names = pa.DictionaryArray.from_arrays(pa.array(s, pa.int8(), mask=s < 0), pa.array(SOURCES)).cast(pa.string())
    moved = [pa.array(mv[g, r, c, k], pa.int64(), mask=s < 0) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.array(frame)[g]), pa.array(r), pa.array(c), names, *moved], names=["frame", "row", "col", "source", "mv_row", "mv_col"])


def _frame_vectors(most_equal: int | None):
    def work(batches):
        held, last, none = [], None, (np.zeros(0, np.int64),) * 3
        for run, frame, *picture in _coded(batches):
            if frame // CODED == run:  # else the one before the run
                held.append((frame, picture, last[2] if last and last[:2] == (run, frame - 1) else none))
            last = (run, frame, picture)
            if len(held) == TOGETHER:
                yield _decided(held, most_equal)
                held = []
        if held:
            yield _decided(held, most_equal)

    return work


def frame_vectors(blocks: DataFrame, most_equal: int | None = MOST_EQUAL) -> DataFrame:
    """Every block: frame, row, col, source (null if it has no copy in the picture before), mv_row, mv_col, as `vectors` decides.

    Runs of CODED pictures, and the one before each run, are dealt over all tasks. A task holds the samples of two pictures, and
    places and codes of TOGETHER pictures, whose waves are decided at once.
    """
    d = blocks.select(*(F.col(c).cast("long").alias(c) for c in ("frame", "row", "col")), "px")
    run = lambda frame: F.floor(frame / CODED)
    d = d.withColumn("run", F.explode(F.array_distinct(F.array(run(F.col("frame")), run(F.col("frame") + 1)))))
    d = dealt(d, "run").sortWithinPartitions("run", "frame")
    return d.mapInArrow(_frame_vectors(most_equal), "frame long, row long, col long, source string, mv_row long, mv_col long")


def motion_totals(found: DataFrame) -> DataFrame:
    """Blocks of each picture by source of their vector, and how many have none."""
    count = lambda s: F.count_if(F.col("source") == s).alias(f"n_{s}")
    return found.groupBy("frame").agg(F.count("*").alias("n_blocks"), *map(count, SOURCES), F.count_if(F.col("source").isNull()).alias("n_none"))


def tile_modes(blocks: DataFrame, found: DataFrame, rows: int = SUPERBLOCK, cols: int = SUPERBLOCK) -> DataFrame:
    """How each tile of rows x cols blocks follows from the picture before: frame, tile_row, tile_col, n_blocks, n_copied, n_motions, mode, lossy.

    found: frame, row, col, mv_row, mv_col of the blocks that have a copy. mode: unchanged (all in place), motion (all by one vector), mixed (all,
    by several), partial, intra. lossy, where a residual may follow: unchanged, moved if any block has a vector, else residual.
    """
    key = [F.col("frame"), F.floor(F.col("row") / rows).alias("tile_row"), F.floor(F.col("col") / cols).alias("tile_col")]
    names = ["frame", "tile_row", "tile_col"]
    still = (F.col("mv_row") == 0) & (F.col("mv_col") == 0)
    mv = found.where("mv_row is not null").select(*key, "mv_row", "mv_col").groupBy(*names).agg(F.count("*").alias("n_copied"), F.count_if(still).alias("still"), F.countDistinct("mv_row", "mv_col").alias("n_motions"))
    d = blocks.select(*key).groupBy(*names).agg(F.count("*").alias("n_blocks")).join(mv, names, "left").fillna(0, ["n_copied", "still", "n_motions"])
    n, k = F.col("n_blocks"), F.col("n_copied")
    mode = F.when(F.col("still") == n, "unchanged").when((k == n) & (F.col("n_motions") == 1), "motion").when(k == n, "mixed").when(k > 0, "partial").otherwise("intra")
    lossy = F.when(F.col("still") == n, "unchanged").when(k > F.col("still"), "moved").otherwise("residual")
    return d.select(*names, "n_blocks", "n_copied", "n_motions", mode.alias("mode"), lossy.alias("lossy"))


def picture_kinds(blocks: DataFrame) -> DataFrame:
    """frame, kind, shown: key for a picture without one before it, existing if it is the one before, block by block, else inter.

    shown is the picture that stands for it: the first of its run of equal ones.
    """
    old = blocks.select((F.col("frame") + 1).alias("frame"), "row", "col", F.col("px").alias("was"))
    # dealt by number: equal samples are sent as few bytes, and an adaptive plan would put too many of them into one task
    key = ["frame", "row", "col"]
    same = dealt(blocks, *key).join(dealt(old, *key), key).groupBy("frame").agg(F.count("*").alias("met"), F.count_if(F.col("px") == F.col("was")).alias("same"))
    n = blocks.groupBy("frame").agg(F.count("*").alias("n"))
    d = n.join(n.select((F.col("frame") + 1).alias("frame"), F.col("n").alias("n_before")), "frame", "left").join(same, "frame", "left")
    kind = F.when(F.col("n_before").isNull(), "key").when((F.col("n") == F.col("n_before")) & F.coalesce(F.col("same") == F.col("n"), F.lit(False)), "existing").otherwise("inter")
    d = d.select("frame", kind.alias("kind"), F.floor(F.col("frame") / RUN).alias("_run"))
    first = F.when(F.col("kind") != "existing", F.col("frame"))
    # a run of equal pictures may go on through many ranges: each brings its last first picture
    last = d.groupBy("_run").agg(F.max(first).alias("last"))
    before = last.select(F.col("_run").alias("_of"), F.max("last").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)).alias("_edge"))
    inside = F.max(first).over(Window.partitionBy("_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("shown", inside).join(before, F.col("_run") == F.col("_of")).select("frame", "kind", F.coalesce("shown", "_edge").alias("shown"))


def coding_order(row: Column, col: Column) -> Column:
    """The place of a block in its row of superblocks: superblock by superblock, inside one by the bits of column and row in turn."""
    bit = lambda v, k: F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1))
    inside = sum((bit(col, k) * 4**k + bit(row, k) * 2 * 4**k for k in range(3)), F.lit(0).cast("long"))
    return F.floor(col / SUPERBLOCK) * SUPERBLOCK * SUPERBLOCK + inside


def picture_copies(blocks: DataFrame, tile_cols: int | None = None) -> DataFrame:
    """Each block that may be copied from an equal one of its own picture: frame, row, col, ref_row, ref_col, kind.

    A source is legal if it is coded before, in the same row of superblocks, in the same tile (tile_cols superblocks
    wide; none given, the picture is one) and at most REACH superblocks to the left. The latest equal block in coding
    order is the nearest in superblocks, so it is the only one to be checked: one look back over equal blocks, no
    pairs. kind: left or above for the block beside, other for the rest.
    """
    d = blocks.select("frame", "row", "col", "px", F.floor(F.col("row") / SUPERBLOCK).alias("sb_row"), coding_order(F.col("row"), F.col("col")).alias("z"))
    tile = F.floor(F.col("col") / (SUPERBLOCK * tile_cols)) if tile_cols else F.lit(0)
    back = Window.partitionBy("frame", "sb_row", "tile", "px").orderBy("z")
    d = d.withColumn("tile", tile).withColumn("ref", F.lag(F.struct("row", "col")).over(back))
    reach = F.floor(F.col("col") / SUPERBLOCK) - F.floor(F.col("ref.col") / SUPERBLOCK) <= REACH
    d = d.where(reach).select("frame", "row", "col", F.col("ref.row").alias("ref_row"), F.col("ref.col").alias("ref_col"))
    down, right = F.col("row") - F.col("ref_row"), F.col("col") - F.col("ref_col")
    return d.withColumn("kind", F.when((down == 0) & (right == 1), "left").when((down == 1) & (right == 0), "above").otherwise("other"))


def local_matches(blocks: DataFrame) -> DataFrame:
    """Each block that equals the one to its left, above or above left in the same superblock, in this order: frame, row, col, kind, bv_row, bv_col in samples."""
    probes = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for k, (r, c) in enumerate(((0, -1), (-1, 0), (-1, -1)))))
    inside = F.filter(probes, lambda p: (F.col("row") % SUPERBLOCK + p["r"] >= 0) & (F.col("col") % SUPERBLOCK + p["c"] >= 0))
    d = blocks.select("frame", "row", "col", "px", F.explode(inside).alias("p"))
    d = d.select("*", (F.col("row") + F.col("p.r")).alias("at_row"), (F.col("col") + F.col("p.c")).alias("at_col"))
    old = blocks.select("frame", F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col("px").alias("ref"))
    best = d.join(old, ["frame", "at_row", "at_col"]).where("px = ref").groupBy("frame", "row", "col").agg(F.min("p").alias("p"))
    kind = F.when(F.col("p.k") == 0, "left").when(F.col("p.k") == 1, "above").otherwise("above left")
    return best.select("frame", "row", "col", kind.alias("kind"), (F.col("p.r") * 8).cast("long").alias("bv_row"), (F.col("p.c") * 8).cast("long").alias("bv_col"))


def _recorded(history: list, value, most: int) -> None:
    if value in history:
        history.remove(value)
    elif len(history) == most:
        history.pop(0)
    history.append(value)


def _range_ends(most: int):
    def work(table: pa.Table) -> pa.Table:
        """The last `most` distinct values of a range of a stream, the latest last: all that a later range needs of it."""
        history: list = []
        for v in reversed(table.sort_by("place").column("value").to_pylist()):
            if v not in history:
                history.append(v)
            if len(history) == most:
                break
        return pa.Table.from_pylist([{"stream": table.column("stream")[0].as_py(), "part": table.column("part")[0].as_py(), "last": history[::-1]}], pa.schema([("stream", pa.string()), ("part", pa.int64()), ("last", pa.list_(pa.string()))]))

    return work


def _range_starts(most: int):
    def work(table: pa.Table) -> pa.Table:
        """What each range of a stream begins with: the history after the ranges before it."""
        history, rows = [], []
        for r in table.sort_by("part").to_pylist():
            rows.append({"stream": r["stream"], "part": r["part"], "history": list(history)})
            for v in r["last"]:
                _recorded(history, v, most)
        return pa.Table.from_pylist(rows, pa.schema([("stream", pa.string()), ("part", pa.int64()), ("history", pa.list_(pa.string()))]))

    return work


def _replayed(most: int):
    def work(table: pa.Table) -> pa.Table:
        t = table.sort_by("place")
        history, out = list(t.column("history")[0].as_py() or []), []
        for v in t.column("value").to_pylist():
            _recorded(history, v, most)
            out.append(",".join(history))
        return pa.Table.from_arrays([t.column("stream"), t.column("place"), pa.array(out, pa.string())], names=["stream", "place", "history"])

    return work


def last_distinct(values: DataFrame, most: int = LAST, span: int = 4096) -> DataFrame:
    """(stream, place, history): after each value of a stream, its last `most` distinct values, the latest last, joined by commas.

    values: stream, place (unique in its stream, its order), value, not null. A value that comes again moves to the end. The
    last distinct values of a range of `span` places are all that later ranges need of it, so ranges of one stream are
    worked on apart; only these short lists are gone through in order.
    """
    d = values.select(F.col("stream").cast("string").alias("stream"), F.col("place").cast("long").alias("place"), F.col("value").cast("string").alias("value"), F.floor(F.col("place") / span).cast("long").alias("part"))
    ends = d.groupBy("stream", "part").applyInArrow(_range_ends(most), "stream string, part long, last array<string>")
    starts = ends.groupBy("stream").applyInArrow(_range_starts(most), "stream string, part long, history array<string>")
    return d.join(starts, ["stream", "part"]).groupBy("stream", "part").applyInArrow(_replayed(most), "stream string, place long, history string")
