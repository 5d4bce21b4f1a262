"""Streams of events: the same functions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rolling(events: DataFrame, at: str, kind: str, value: str, every: str = "1 hour", late: str = "20 minutes") -> DataFrame:
    """Per window and kind: count, mean and maximum. On a stream, a window closes when the watermark passes it; watermarks need times with a zone."""
    source = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return source.groupBy(F.window(at, every).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("highest")).select(F.col("w.start").alias("start"), kind, "n", "mean", "highest")


def replay(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
