"""Event-time operators that serve streams and batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str | None = "10 minutes", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts and summed values of event types in sliding windows; ``late`` is the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row per key: for a stream the first within the watermark, for a batch the earliest."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("x")).select(*keys, "x.*")
