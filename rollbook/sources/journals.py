"""Logs as JSON lines: appended to, read without what is damaged, followed as a stream, and cut to the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows to a log; every append makes files of its own, so writers do not wait for each other."""
    rows.write.mode("append").json(folder)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The entries of a log; lines that are no entry of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def follow(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A log's entries as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)


def newest(entries: DataFrame, n: int, at: str = "ts", order: str = "id") -> DataFrame:
    """The last n entries by time, then ``order``: what a log is cut to. n is what is kept, so it bounds the sort of the result."""
    return entries.orderBy(F.col(at).desc_nulls_last(), F.desc(order)).limit(n)
