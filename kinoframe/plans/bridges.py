"""Trace and block tables read out of the star schema and the embeddings.

A line item stands for a superblock of a trace, an embedding of 64 floats for
an 8x8 block of 8-bit samples. Column names follow the trace schemas.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The categories of bits of a trace. Fixed values.
CATEGORIES = ("partition_bits", "luma_mode_bits", "chroma_mode_bits", "residual_bits", "intrabc_bits", "inter_bits", "palette_bits", "other_bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers on this machine find the package where the driver did
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, source, frame, sb_x, sb_y, bits and eight category columns, one row a line item."""
    li = table(spark, sf_dir, "lineitem")
    bits = F.floor("l_extendedprice").cast("long")
    parts = [F.floor(bits / (k + 9)).cast("long") for k in range(7)]
    return li.select(
        F.col("l_returnflag").alias("case"),
        F.col("l_linestatus").alias("source"),
        F.col("l_linenumber").cast("long").alias("frame"),
        F.pmod("l_partkey", F.lit(16)).alias("sb_x"),
        F.pmod("l_suppkey", F.lit(9)).alias("sb_y"),
        bits.alias("bits"),
        *(p.alias(c) for p, c in zip(parts, CATEGORIES, strict=False)),
        F.col("l_quantity").cast("long").alias(CATEGORIES[-1]),
    )


#: The same rows in DuckDB.
SUPERBLOCKS_SQL = (
    "SELECT l_returnflag AS \"case\", l_linestatus AS source, l_linenumber::BIGINT AS frame, l_partkey % 16 AS sb_x, l_suppkey % 9 AS sb_y, floor(l_extendedprice)::BIGINT AS bits, "
    + ", ".join(f"floor(floor(l_extendedprice) / {k + 9})::BIGINT AS {c}" for k, c in enumerate(CATEGORIES[:-1]))
    + f", l_quantity::BIGINT AS {CATEGORIES[-1]} FROM lineitem"
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, label, px (64 samples of 0..255 in raster order)."""
    e = table(spark, sf_dir, "embeddings")
    sample = lambda x: F.greatest(F.least(F.floor((x.cast("double") + 0.6) * 200), F.lit(255)), F.lit(0)).cast("int")
    return e.select(F.col("vec_id").alias("block_id"), "label", F.transform("embedding", sample).alias("px"))


BLOCKS_SQL = "SELECT vec_id AS block_id, label, list_transform(embedding, lambda x: greatest(least(floor((x::DOUBLE + 0.6) * 200), 255), 0)::INTEGER) AS px FROM embeddings"
