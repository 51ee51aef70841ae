"""Replay of an event table as a stream: hourly counts and sums, kept up to date batch by batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one; under a temporary one only in local mode with none set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-kinoframe-", dir="/tmp"))
    return f"{root.rstrip('/')}/kinoframe-files-{spark.sparkContext.applicationId}"


def purge(spark: SparkSession) -> None:
    """Delete all files that this application's sources and replays wrote, when no result that reads them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hourly(events: DataFrame) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


def hourly_replay(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The stream's last state of each hour and type: every batch writes the groups it changed, the latest wins.

    A batch that runs again after a failure overwrites its own folder.
    """
    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{table}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", table).parquet(folder)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    hourly(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("hour", "event_type").agg(F.max_by("n", "batch_id").alias("n"), F.max_by("cents", "batch_id").alias("cents"))
