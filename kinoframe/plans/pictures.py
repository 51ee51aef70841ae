"""Pictures made of the given tables, with areas that repeat and move.

An order is a place of a picture of 16 by 24 blocks, in key order; the last picture may be cut short. What is
seen there is one of the blocks of the embeddings: a pattern that moves one column to the left every other
picture, with some places that change at random, a flat band on top and a band of few levels below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import dealt
from .bridges import blocks, table

ROWS, COLS = 16, 24
#: Blocks of the moving pattern and of the places that change, by id. Fixed values.
MOVING, CHANGING = (8, 40), (200, 23)
#: Places of one task: those of 256 pictures.
PLACES_A_TASK = 256 * ROWS * COLS


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the places need, however few the session shuffles into: what one task sorts does not grow with the table."""
    return -(-table(spark, sf_dir, "orders").count() // PLACES_A_TASK)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, row, col, px (64 samples of a block, in raster order), dealt by frame.

    The places are dealt before they have samples; the 63 blocks that can be seen at all go to every task.
    """
    key = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.floor(key / (ROWS * COLS)).alias("frame"), F.floor(key % (ROWS * COLS) / COLS).alias("row"), (key % COLS).alias("col"), "o_custkey")
    d = dealt(d, "frame", tasks=tasks(spark, sf_dir))
    moving = ((F.col("col") + F.floor(F.col("frame") / 2)) * 7 + F.col("row") * 5) % MOVING[1] + MOVING[0]
    d = d.withColumn("seen", F.when(F.col("o_custkey") % 11 == 0, CHANGING[0] + F.col("o_custkey") % CHANGING[1]).otherwise(moving))
    ids = [low + i for low, n in (MOVING, CHANGING) for i in range(n)]
    d = d.join(F.broadcast(blocks(spark, sf_dir).where(F.col("block_id").isin(ids)).select(F.col("block_id").alias("seen"), "px")), "seen")
    flat = F.array_repeat((40 + F.floor(F.col("col") / 8) * 9).cast("int"), 64)
    few = F.transform("px", lambda v: (F.floor(v / 100) * 100).cast("int"))
    return d.select("frame", "row", "col", F.when(F.col("row") < 4, flat).when(F.col("row") < 8, few).otherwise(F.col("px")).alias("px"))


#: The same rows in DuckDB.
PICTURES_SQL = f"""
SELECT frame, row, col, CASE WHEN row < 4 THEN list_transform(px, lambda v: (40 + col // 8 * 9)::INTEGER) WHEN row < 8 THEN list_transform(px, lambda v: v // 100 * 100) ELSE px END AS px
FROM (SELECT *, CASE WHEN o_custkey % 11 = 0 THEN 200 + o_custkey % 23 ELSE ((col + frame // 2) * 7 + row * 5) % 40 + 8 END AS seen
      FROM (SELECT o_orderkey // {ROWS * COLS} AS frame, o_orderkey % {ROWS * COLS} // {COLS} AS row, o_orderkey % {COLS} AS col, o_custkey FROM orders))
JOIN blocks ON block_id = seen"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pictures with two more planes of the same size, cb and cr, that follow px roughly."""
    cb = F.transform("px", lambda v, i: (F.floor(v * 3 / 4) + 20 + i % 3).cast("int"))
    cr = F.transform("px", lambda v, i: (255 - v).cast("int"))
    return pictures(spark, sf_dir).select("*", cb.alias("cb"), cr.alias("cr"))


PLANES_SQL = "SELECT *, list_transform(px, lambda v, i: v * 3 // 4 + 20 + (i - 1) % 3) AS cb, list_transform(px, lambda v: 255 - v) AS cr FROM pictures"
