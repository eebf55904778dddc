"""Streams of edit-log entries, kept as the latest state of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, ts timestamp, type string, local_id long, value double"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of entries as they arrive."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def latest(log: DataFrame) -> DataFrame:
    """local_id, seq, type, value of the last entry of each item; a streaming aggregation, for update or complete mode."""
    last = log.groupBy("local_id").agg(F.max_by(F.struct("type", "value"), "seq").alias("last"), F.max("seq").alias("seq"))
    return last.select("local_id", "seq", F.col("last.type").alias("type"), F.col("last.value").alias("value"))


def activity(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Entries by kind in windows of event time; entries later than the watermark are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def upsert(target: str):
    """For foreachBatch: a batch's last entries over the table at ``target``, written as a new version beside it.

    Version k holds the state after batch k, so that a batch that is run again overwrites its own version only.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = latest(batch)
        spark = batch.sparkSession
        if number:
            old = spark.read.parquet(f"{target}/version={number - 1}")
            both = old.unionByName(new)
            new = both.groupBy("local_id").agg(F.max_by(F.struct("type", "value"), "seq").alias("last"), F.max("seq").alias("seq")).select("local_id", "seq", "last.type", "last.value")
        new.write.mode("overwrite").parquet(f"{target}/version={number}")

    return write
