"""Structured Streaming over the append-only log and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """New files of a JSONL log as a stream; corrupt lines are kept in _corrupt_record for counting."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def once_per_run(stream: DataFrame, keys: list[str], at: str = "logged_at", late: str = "1 hour") -> DataFrame:
    """Each key once, whatever is appended again within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; works on streams and batches."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append(stream: DataFrame, path: str, checkpoint: str):
    """Run what has arrived and append it as parquet; restarts go on where the checkpoint is."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
