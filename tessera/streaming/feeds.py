"""Polling and triggers as streams: change feeds, append logs, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import day_bucket

#: Poll interval (fixed value).
POLL = "5 minutes"


def poll(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = POLL) -> StreamingQuery:
    """Hand each micro-batch of a change feed to ``apply``. A batch that is run again
    after a failure has the same number. A second writer is kept out by a lock of
    ``sources.locks`` around the call, not by the checkpoint."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Files that appear in a folder, as requests to synchronise."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("value").alias("request"), F.current_timestamp().alias("seen"))


def log_stream(records: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append records to JSON lines by kind and day."""
    rows = records.withColumn("day", day_bucket(F.col("ts")))
    writer = rows.writeStream.format("json").partitionBy("kind", "day").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_requests(records: DataFrame, key: str = "request_id", at: str = "at", late: str = "1 hour") -> DataFrame:
    """Each request once within the allowed lateness, with bounded state."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(records: DataFrame, at: str = "at", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Records of each kind in tumbling windows."""
    return records.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n")
