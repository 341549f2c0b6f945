"""Structured Streaming forms: watermarked bars, first-wins deduplication, sessions, exactly-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Event files as they arrive, with time as an instant."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_bars(stream: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Bars by event time; rows later than the watermark don't count, and a bar is emitted once it can't change."""
    at = F.struct("ts", "event_id")
    bars = stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))


def first_of_each(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of a key; its state goes with the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def user_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def exactly_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A table whose batches are committed once each, resumed from the checkpoint after a failure."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
