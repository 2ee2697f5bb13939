"""Structured Streaming forms of batch plans: daily counts, run-wide deduplication, and items to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.sources.sinks import ITEM_TYPES


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by UTC day and type; a day is final once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


def once_per_run(items: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first item of each key, remembered for as long as the watermark allows."""
    return items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def route(folder: str):
    """A foreachBatch function that appends each type of item to its own table. A batch that runs again
    replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        for kind in ITEM_TYPES:
            batch.filter(F.col("item_type") == kind).write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")

    return write


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there and stops."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
    query.awaitTermination()
    return query
