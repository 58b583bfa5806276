"""The decision log as a stream: progress per session, and the applied rewrite of each unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.scratch import scratch_path


def progress(log: DataFrame) -> DataFrame:
    """Counts of actions for each document; a plain aggregate, so the same plan serves batches and streams."""
    on = lambda a: F.count_if(F.col("action") == a)
    return log.groupBy("doc_id").agg(F.count("*").alias("n_actions"), on("apply").alias("n_applied"), on("dismiss").alias("n_dismissed"), F.max("sequence").alias("last_sequence"))


def applied_units(log: DataFrame) -> DataFrame:
    """The sequence and value that stand applied for each unit: the last apply wins."""
    applied = log.filter("action = 'apply'")
    return applied.groupBy("doc_id", "unit_id").agg(F.max("sequence").alias("sequence"), F.max_by("value", "sequence").alias("value"))


def windowed_progress(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Actions in each window of event time; rows later than the watermark are dropped in a stream."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def run_once(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming frame over what is there now and gives its last result as a table.

    Results and checkpoint go to the shared folder; a batch that is run again overwrites its own result.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/result")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")
