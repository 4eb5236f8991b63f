"""Extension: error events as a stream. The batch fold in ``operators.errors`` is the reference semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id string, event_id long, ts timestamp, stage string, error_msg string, is_retry boolean"


def error_events(spark: SparkSession, path: str, schema: str = EVENTS, delay: str = "1 hour") -> DataFrame:
    """Events of new Parquet files below ``path``, each once within the delay."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def errors_per_window(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Errors and retries by stage and time window."""
    grouped = events.groupBy(F.window("ts", width), "stage")
    counts = grouped.agg(F.count_if(~F.col("is_retry")).alias("errors"), F.count_if("is_retry").alias("retries"))
    return counts.select(F.col("window.start").alias("start"), "stage", "errors", "retries")
