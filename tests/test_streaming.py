"""The stream gives the batch's windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import learning
from rollbook.streaming import requests, windows


def test_rolling_on_a_stream_equals_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = windows.rolling(windows.replay(spark, str(tmp_path / "in"), events.schema, files=10), "ts", "event_type", "value")
    run = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = windows.rolling(events, "ts", "event_type", "value")
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, batch.collect()))


def test_requests_asked_again_or_given_up(spark, tmp_path):
    rows = [
        (1, "2024-01-01 10:00:00", "find red sun", 0, ["a"]), (2, "2024-01-01 10:01:00", "Find red sun ", 0, ["a"]), (3, "2024-01-01 10:02:00", "red sun ltd", 1, ["a", "b", "a"]), (4, "2024-01-01 10:03:00", "other", 0, ["c", "d"]),
        (5, "2024-01-01 10:30:00", "again", 1, ["c"]), (6, "2024-01-01 10:31:00", "lone", None, ["e", "", None]), (7, "2024-01-01 11:00:00", "x", 0, []), (8, "2024-01-01 11:01:00", "y", 0, None), (9, "2024-01-01 13:00:00", "z", 1, ["f"]),
        (10, None, "no time", 0, ["a"]), (11, "2024-01-01 13:00:01", "last", 0, ["g"]), (12, "2024-01-01 13:01:00", "lone", 1, ["e"]),
    ]
    df = spark.createDataFrame(rows, "id bigint, ts string, text string, rows int, entities array<string>").withColumn("ts", F.to_timestamp("ts"))
    for part in (range(1, 3), range(3, 7), range(7, 13)):
        df.where(F.col("id").isin(*part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = requests.outcomes(windows.replay(spark, str(tmp_path / "in"), df.schema, files=1), late="5 minutes")
    run = stream.writeStream.format("memory").queryName("asked").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.table("asked").collect()))
    assert got == [("a", 1, "rephrased", 3), ("a", 2, "rephrased", 3), ("c", 4, "abandoned", None), ("d", 4, "abandoned", None), ("e", 6, "abandoned", None)]
    assert {(i, by) for _, i, o, by in got if o == "rephrased"} == set(map(tuple, learning.rephrased(df.where("ts is not null")).collect()))
