"""Tables in the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and the master is local (tests, one machine) a temporary folder, which is then set.

    On a cluster a folder of one machine would lose rows without a word, so there it is an error.
    """
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet and read again: a lost executor loses none of it. Tables of one application lie in one folder."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "rollbook", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing still to be run reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that no plan can read any more: it does so only when the driver collects garbage, which small heaps of large jobs seldom do."""
    spark._jvm.System.gc()
