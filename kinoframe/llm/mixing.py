"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share a budget of words; a target stops at twice its source's words and the
excess goes to the others by weight. Each document's rate r solves

    min sum KL(r / 2, 1 / 2)   with   sum r * size = target   for each source,

so r = 2 / (1 + exp(-lambda * size / scale)): an exponential tilt of the even
rate 1, held under the cap of 2. The convex dual has one lambda a source.
Newton steps, bracketed, solve it over the table (source, size, count), which
Spark aggregates; documents themselves are read once. Rates become copies by
floor(rate + u) with a hash dither u, whose shift per source is set by three
rounds of histograms so that the words taken meet the target to about one document.

Nulls: a null text has size 0, a null source is a source of its own. A source
without words takes nothing. Repeated rows count as often as they stand.
Reruns agree: dither comes from a hash of doc_id (null: a fixed value) and size. Rows that
are alike in id, source and size have the same result columns, so they are counted and
numbered from 1: each has a dither of its own, and a null or shared id does not gain all its
extra copies at once.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, WORD, durable, numbered, release

WEIGHTS, BUDGET, MAX_RATE = (5, 2, 1), 1.5, 2.0
NEWTON_STEPS, BINS, ROUNDS = 40, 1024, 3
TOLERANCE = 1e-6
#: A column that input tables are not expected to have.
COPIES = "__kinoframe_copies__"
#: Parts that the rows of one source are dealt to when they meet its row.
SPREAD = 64
#: Rows alike that one row stands for until they are told apart.
ALIKE = 4096


def targets_of(sizes: dict[str | None, int], budget: float = BUDGET) -> dict[str | None, float]:
    """Target words of each source: shares by weight, water-filled under the caps."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), budget * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > MAX_RATE * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: MAX_RATE * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in full]
    return out


def _rate(lam: Column, x: Column) -> Column:
    return MAX_RATE / (1 + F.exp(-F.least(F.greatest(lam * x, F.lit(-500.0)), F.lit(500.0))))


def solve_dual(hist: DataFrame, state: DataFrame) -> DataFrame:
    """Newton iterations; hist (source, size, n), state (source, scale, target, source_size) gains lam."""
    state = durable(state.withColumns({"lam": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "step": F.lit(1.0)}), "dual")
    for _ in range(NEWTON_STEPS):
        x = F.col("size") / F.col("scale")
        r = _rate(F.col("lam"), x)
        sums = hist.join(state, hist["source"].eqNullSafe(state["source"])).select(
            state["source"], (F.col("n") * F.col("size") * r).alias("words"), (F.col("n") * F.col("size") * x * r * (1 - r / MAX_RATE)).alias("slope")
        )
        sums = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("slope").alias("slope"))
        moved = state.join(sums.withColumnRenamed("source", "_s"), state["source"].eqNullSafe(F.col("_s")), "left").drop("_s")
        over = F.col("words") > F.col("target")
        moved = moved.withColumns({"low": F.when(~over, F.col("lam")).otherwise(F.col("low")), "high": F.when(over, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") + (F.col("target") - F.col("words")) / F.greatest(F.col("slope"), F.lit(1e-12))
        # beyond the bracket Newton has overshot: go to its middle, or outwards while a side is open
        middle = F.when(F.col("high") >= 1e6, F.col("lam") * 2 + 1).when(F.col("low") <= -1e6, F.col("lam") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - F.col("lam")) < F.abs(F.col("lam")) + 2)
        done = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        moved = moved.withColumns({"step": F.when(done, 0.0).otherwise(1.0), "lam": F.when(done, F.col("lam")).when(inside, newton).otherwise(middle)})
        new = durable(moved.drop("words", "slope"), "dual")
        release(state)
        state = new
        if not state.where((F.col("step") > 0) & (F.col("target") < MAX_RATE * F.col("source_size")) & (F.abs("lam") < 1e5)).head(1):
            break
    else:
        warnings.warn(f"a source's rates did not meet its target within {NEWTON_STEPS} Newton steps", stacklevel=2)
    return state.drop("low", "high", "step")


def _meet_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (doc_id, source, ...) with the one row of table (_s, ...) for each source, null if none; a hot source is spread."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SPREAD)).cast("int"))
    table = table.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.join(table, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_part", "_p", "_s")


def _numbered_alike(sized: DataFrame) -> DataFrame:
    """sized (doc_id, source, size) with _salt: null for a row like no other, else its number among those alike, however many there are."""
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / ALIKE)))
    cut = alike.where("_n > 1").select("doc_id", "source", "size", "_n", runs.alias("_run")).hint("rebalance")
    each = F.explode(F.sequence(F.col("_run") * ALIKE + 1, F.least((F.col("_run") + 1) * ALIKE, "_n")))
    return alike.where("_n = 1").select("doc_id", "source", "size", F.lit(None).cast("long").alias("_salt")).union(cut.select("doc_id", "source", "size", each.alias("_salt")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = BUDGET, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken and, if given, row_col.

    The dither is by id and size, and for rows that another row is alike in id, source and size by their number among
    these, or by row_col, if given.
    """
    sized = docs.select(
        *[row_col] * bool(row_col), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    if row_col:
        shared = sized.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
        sized = sized.join(shared, "doc_id", "left").withColumn("_salt", F.when(F.col("doc_id").isNull() | F.col("_n").isNotNull(), F.col(row_col))).drop("_n")
    else:
        sized = _numbered_alike(sized)
    salt = ["_salt"]
    sized = durable(sized, "mix-sizes")
    hist = durable(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    rows = totals.collect()  # one row a source
    target = targets_of({r["source"]: r["source_size"] for r in rows}, budget)
    spark = docs.sparkSession
    schema = "source string, source_size long, scale double, target double"
    state = solve_dual(hist.where("size > 0"), spark.createDataFrame([(r["source"], r["source_size"], r["scale"] or 1.0, float(target[r["source"]])) for r in rows], schema))
    state = state.withColumnRenamed("source", "_s")
    at = F.when(F.col("target") >= MAX_RATE * F.col("source_size"), F.lit(MAX_RATE)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale")))
    rated = _meet_source(sized, state).withColumn("rate", F.when(F.col("size") == 0, 0.0).otherwise(at)).drop("lam", "scale")
    base, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", *salt), F.lit(1 << 40)) / float(1 << 40)
    # a document gains its extra copy once the shift of its source reaches `flip`
    rated = rated.withColumns({"base": base.cast("long"), "flip": F.when(part > 0, 1 - part - u)})
    cuts = _shifts(rated)
    out = _meet_source(rated, cuts.withColumnRenamed("source", "_s"))
    copies = F.col("base") + F.when(F.col("flip") < F.coalesce("shift", F.lit(0.0)), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("base", "flip", "shift", *salt)


def _shifts(rated: DataFrame) -> DataFrame:
    """(source, shift): below it, the extra copies bring a source's words nearest to its target."""
    need = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    state = durable(need.withColumns({"low": F.lit(-1.0), "width": F.lit(2.0)}), "mix-shift")
    extras = rated.where("flip is not null").select(F.col("source").alias("_s"), "size", "flip")
    for _ in range(ROUNDS):
        k = F.floor((F.col("flip") - F.col("low")) / F.col("width") * BINS)
        bins = extras.join(state, F.col("_s").eqNullSafe(state["source"])).where(k.between(0, BINS - 1)).groupBy("source", k.alias("bin")).agg(F.sum("size").alias("w"))
        # a source has at most BINS rows here
        per = bins.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("bins")).withColumnRenamed("source", "_s")
        walk = F.expr(
            """aggregate(bins, named_struct('sum', 0D, 'bin', -1L, 'open', true), (a, b) ->
               IF(a.open AND a.sum + b.w <= need, named_struct('sum', a.sum + b.w, 'bin', b.bin, 'open', true), IF(a.open, named_struct('sum', a.sum, 'bin', b.bin - 1, 'open', false), a)))"""
        )
        moved = state.join(per, state["source"].eqNullSafe(F.col("_s")), "left").withColumn("_w", F.when(F.col("bins").isNotNull(), walk))
        step = F.when(F.col("_w").isNull(), F.lit(0)).when(F.col("_w.open"), F.lit(BINS - 1)).otherwise(F.col("_w.bin") + 1)
        moved = moved.select("source", (F.col("need") - F.coalesce("_w.sum", F.lit(0.0))).alias("need"), (F.col("low") + step * F.col("width") / BINS).alias("low"), (F.col("width") / BINS).alias("width"))
        new = durable(moved, "mix-shift")
        release(state)
        state = new
    # of the last bin, one document at most in practice: take it if that comes nearer
    k = F.col("flip").between(F.col("low"), F.col("low") + F.col("width"))
    last = extras.join(state, F.col("_s").eqNullSafe(state["source"])).where(k).groupBy("source").agg(F.sum("size").alias("w")).withColumnRenamed("source", "_s")
    take = F.coalesce(F.abs(F.col("need") - F.col("w")) < F.abs(F.col("need")), F.lit(False))
    return state.join(last, state["source"].eqNullSafe(F.col("_s")), "left").select("source", F.when(take, F.col("low") + F.col("width")).otherwise(F.col("low")).alias("shift"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, whatever ids rows share; columns as they were."""
    rows = numbered(docs, "mix-rows")
    copies = mix(rows, id_col, row_col=ROW, **options).where("copies > 0").select(ROW, F.col("copies").alias(COPIES))
    many = rows.join(copies, ROW)
    return many.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(COPIES))).alias(COPIES)).select(*docs.columns)
