"""Line formats: JSON lines, key=value logs, CSV manifests and Markdown tables, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """JSON lines by a schema: unknown fields are ignored, missing ones null or their default."""
    return spark.read.schema(schema).json(path).fillna(defaults or {})


def nested_rows(records: DataFrame, arrays: dict[str, tuple[str, ...]], keep: list[str]) -> DataFrame:
    """The elements of several arrays of structs in one table, from one read: kept columns, table, place, name and values.

    arrays: column -> its number fields beside `name`; a missing number is 0, a missing name empty. A record without elements in an array
    (null or empty) keeps one row of it, with a null place; `value` and `more` are the first and second number field.
    """

    def elements(column: str, fields: tuple[str, ...]) -> Column:
        number = lambda e, k: F.coalesce(e[fields[k]], F.lit(0)).cast("long") if k < len(fields) else F.lit(None).cast("long")
        one = lambda place, name, value, more: F.struct(F.lit(column).alias("table"), place.cast("long").alias("place"), name.cast("string").alias("name"), value.alias("value"), more.alias("more"))
        some = F.transform(F.col(column), lambda e, i: one(i, F.coalesce(e["name"], F.lit("")), number(e, 0), number(e, 1)))
        none = F.array(one(*(F.lit(None).cast(t) for t in ("long", "string", "long", "long"))))
        return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, some).otherwise(none)

    return records.select(*keep, F.explode(F.concat(*(elements(c, f) for c, f in arrays.items()))).alias("_e")).select(*keep, "_e.*")


#: The records of an encoder's statistics: unknown fields are ignored, missing ones null.
STATS = "kind string, source string, frame_index long, bitstream_bytes long, stages array<struct<name: string, ns: long, count: long>>, counters array<struct<name: string, value: long>>"


def read_stats(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind of a JSON-lines file of statistics; a missing frame is 0, missing bytes are 0."""
    return read_jsonl(spark, path, STATS, {"frame_index": 0, "bitstream_bytes": 0}).where(F.col("kind") == kind).drop("kind")


def stats_rows(records: DataFrame) -> DataFrame:
    """Stages (ns, count) and counters (value) of statistics records as one table of children."""
    return nested_rows(records, {"stages": ("ns", "count"), "counters": ("value",)}, ["source", "frame_index", "bitstream_bytes"])


def stage_totals(children: DataFrame) -> DataFrame:
    """Per source and stage: calls, nanoseconds, share of the source's, frames; records without stages are counted apart with an empty name."""
    s = children.where(F.col("table") == "stages").groupBy("source", F.coalesce("name", F.lit("")).alias("stage")).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("nanos"), F.coalesce(F.sum("more"), F.lit(0)).alias("count"), F.countDistinct("frame_index").alias("frames"))
    whole = s.groupBy("source").agg(F.sum("nanos").alias("whole"))
    return s.join(whole, "source").withColumn("share", F.when(F.col("whole") > 0, F.col("nanos") / F.col("whole")).otherwise(0.0)).drop("whole")


def trace_spec(spec: str) -> tuple[str, str | None, str]:
    """(case, source, path) of [CASE/]SOURCE=PATH; a missing case is the file's stem, a missing source null."""
    label, cut, path = spec.partition("=")
    if not cut:
        label, path = "", spec
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    case, slash, source = label.partition("/")
    if not slash:
        case, source = "", label
    return case.strip() or stem, source.strip() or None, path


def read_traces(spark: SparkSession, specs: list[str], schema: StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The rows of all traces, one after the other: case, source (the spec's, else the row's own, else the file's stem) and order_, the spec's place."""
    out = None
    for i, spec in enumerate(specs):
        case, source, path = trace_spec(spec)
        d = read_jsonl(spark, path, schema, defaults)
        own = F.coalesce(F.lit(source).cast("string"), F.col("source") if "source" in d.columns else F.lit(None).cast("string"), F.lit(trace_spec(path)[0]))
        d = d.withColumns({"case": F.lit(case), "source": own, "order_": F.lit(i)})
        out = d if out is None else out.unionByName(d)
    return out


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of a report, one JSON document a file with a list `results`; a report without any has no rows."""
    d = spark.read.schema(f"results array<struct<{schema}>>").option("multiLine", True).json(path)
    return d.select(F.explode("results").alias("r")).select("r.*")


def write_key_values(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One line a row: key=value for every column, with spaces between; null values are left out."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns]
    rows.select(F.concat_ws(" ", *parts).alias("value")).write.mode("errorifexists").text(path)


def key_values(line: Column) -> Column:
    """map<string,string> of a key=value line; the last of repeated keys counts, words without = are skipped."""
    words = F.filter(F.split(line, r"\s+"), lambda w: F.instr(w, "=") > 1)
    key = lambda w: F.substring_index(w, "=", 1)
    # sorted by key and place, the last of a key is the one before another key
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(key(w).alias("key"), i.alias("i"), w.substr(F.instr(w, "=") + 1, F.length(w)).alias("value"))))
    marked = lambda p: F.transform(p, lambda e, i: F.struct((~F.get(p, i + 1)["key"].eqNullSafe(e["key"])).alias("last"), e.alias("e")))
    last = F.transform(F.array(placed), lambda p: F.filter(marked(p), lambda m: m["last"]))[0]
    return F.map_from_entries(F.transform(last, lambda m: F.struct(m["e"]["key"], m["e"]["value"])))


def read_key_values(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a key=value log with the given fields and types; a value that does not cast is null."""
    m = key_values(F.col("value"))
    return spark.read.text(path).select(m.alias("m")).select(*(F.col("m")[name].try_cast(kind).alias(name) for name, kind in fields.items()))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV manifest by its header; rows that do not fit the schema raise."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def markdown_table(report: DataFrame, columns: list[str], order: dict[str, bool]) -> DataFrame:
    """(rank, line): a whole Markdown table, its head, its rule and its rows, sorted by the columns of `order` (true: rising); names and cells are escaped alike."""
    bar = lambda texts: "| " + " | ".join(t.replace("|", "\\|") for t in texts) + " |"
    top = report.sparkSession.createDataFrame([(0, bar(columns)), (1, bar(["---"] * len(columns)))], "rank int, line string")
    rows = markdown_rows(report, columns, [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(order)]).withColumn("rank", F.lit(2))
    keys = [F.col(f"_k{i}").asc() if rising else F.col(f"_k{i}").desc() for i, rising in enumerate(order.values())]
    return top.unionByName(rows, allowMissingColumns=True).orderBy("rank", *keys).select("rank", "line")


def markdown_rows(report: DataFrame, columns: list[str], more: list[Column] | None = None) -> DataFrame:
    """The row lines of a Markdown table: bars escaped, nulls as n/a; with more columns, if given."""
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("n/a"))
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"), *(more or []))
