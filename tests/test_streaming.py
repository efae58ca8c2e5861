"""Streams over split files give what their batch twins give."""

import datetime

import pytest
from pyspark.sql import functions as F

from bazaarline.operators import sequences as seq
from bazaarline.streaming import events as streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = datetime.datetime(2024, 1, 1)
    kinds = ["error", "error", "view", "error", "error", "error", "click"]
    rows = [(k, base + datetime.timedelta(minutes=k), k % 3, kinds[(k // 3) % 7]) for k in range(240)]
    where = str(tmp_path_factory.mktemp("events") / "in")
    for k in range(4):  # files in order of time
        spark.createDataFrame(rows[k * 60 : k * 60 + 60], SCHEMA).coalesce(1).write.mode("append").parquet(where)
    return where


def run(spark, folder, make, mode, tmp_path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_tumbling_counts(spark, folder, tmp_path):
    make = lambda df: streams.tumbling_counts(df, "ts", "event_type", "30 minutes")
    batch = sorted(map(tuple, make(spark.read.schema(SCHEMA).parquet(folder)).collect()))
    assert run(spark, folder, make, "complete", tmp_path, "tumbling") == batch


def test_first_seen_only(spark, folder, tmp_path):
    make = lambda df: streams.first_seen_only(df, "ts", ["user_id", "event_type"], "6 hours").select("user_id", "event_type")
    batch = sorted(map(tuple, spark.read.schema(SCHEMA).parquet(folder).select("user_id", "event_type").distinct().collect()))
    assert run(spark, folder, make, "append", tmp_path, "seen") == batch


def test_error_streaks(spark, folder, tmp_path):
    error = F.col("event_type") == "error"
    batch = seq.running_streak(spark.read.schema(SCHEMA).parquet(folder), "user_id", ["ts", "event_id"], error, ~error).where("streak = 3").select("user_id", "event_id", "streak")
    assert run(spark, folder, streams.error_streaks, "append", tmp_path, "streaks") == sorted(map(tuple, batch.collect()))


def test_round_robin():
    assert [streams.round_robin(k, ["a", "b"]) for k in range(3)] == ["a", "b", "a"]
