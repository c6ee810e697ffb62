"""Extension: running window statistics over a stream of session events.

Export works on finished files; this is the same grouping for rows that
are still arriving. Counts per session and event-time window are partial aggregates with a
watermark, so state is bounded by the lateness allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder (or one file) of event parquet as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A stream reads folders and patterns: braces around the last name are a pattern of that name alone.
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}" if folder else f"{{{name}}}")


def activity(events: DataFrame, every: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events, messages and closings per session and time window."""
    return (
        events.withColumn("at", F.col("event_ts").cast("timestamp"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", every).alias("period"), "session_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "message").alias("messages"), F.count_if(F.col("event_type") == "compaction").alias("closings"))
    )
