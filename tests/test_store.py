"""Folds in order and tables kept by key."""

import os

import pytest
from pyspark.sql import functions as F

from bazaarline.operators import folds
from bazaarline.sources.store import Store


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") * 2).alias("price"), F.lit("new").alias("status"), F.lit(0).cast("long").alias("seen"))
    return Store(str(tmp_path / "store"), "id", "id long, price long, status string, seen long", 64).create(rows.unionByName(spark.createDataFrame([(None, 1, "x", 0)], "id long, price long, status string, seen long")))


def state(spark, store):
    return {r.id: (r.price, r.status, r.seen) for r in store.read(spark).collect()}


def test_a_patch_rewrites_its_buckets_only(spark, store):
    before, rows = files(store.path), state(spark, store)
    assert len(rows) == 2000
    ten = spark.range(10).withColumn("id", F.col("id") * 7)
    n = store.patch(ten, {"status": F.lit("gone"), "price": F.col("price") + 1 - F.col("price") % 2})
    assert 1 <= n <= 10
    after, got = files(store.path), state(spark, store)
    gone = {p.split("_bucket=")[1].split("/")[0] for p in before if p not in after}
    assert len(gone) == n and sum(p in after for p in before) == len(before) - n
    want = rows | {k * 7: (rows[k * 7][0] + 1, "gone", 0) for k in range(10)}
    assert got == want
    store.patch(ten, {"status": F.lit("gone"), "price": F.col("price") + 1 - F.col("price") % 2})
    assert state(spark, store) == want


def test_upserts(spark, store):
    rows = state(spark, store)
    new = spark.createDataFrame([(5, 50, "a", 1), (5, 51, "b", 2), (9000, 1, "c", 1), (None, 1, "d", 1), (6, 60, "e", 1)], "id long, price long, status string, seen long")
    want = rows | {5: (51, "b", 2), 9000: (1, "c", 1), 6: (60, "e", 1)}
    for _ in range(2):
        store.upsert(new, "seen")
        assert state(spark, store) == want
    store.upsert(new.withColumn("price", F.lit(7).cast("long")), "seen", keep=F.col("old.status") == "e")
    assert state(spark, store) == want | {5: (7, "b", 2), 9000: (7, "c", 1)}


def test_deletes_down_to_the_last_row(spark, store):
    assert store.delete(spark.range(0)) == 0
    store.delete(spark.range(1, 2000))
    assert list(state(spark, store)) == [0]
    store.delete(spark.range(1))
    assert state(spark, store) == {}
    store.upsert(spark.createDataFrame([(3, 1, "a", 1)], "id long, price long, status string, seen long"), "seen")
    assert state(spark, store) == {3: (1, "a", 1)}


def test_incremental_mean(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), k, rng.choice([None, round(rng.uniform(1, 90), 2)])) for k in range(3000)]
    want: dict = {}
    for key, _, x in rows:
        if x is not None:
            n, mean = want.get(key, (0, 0.0))
            want[key] = (n + 1, math.floor((mean * n + x) / (n + 1) * 100 + 0.5) / 100 if n else x)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, x double").repartition(5)
    assert {r.k: (r.n, r.mean) for r in folds.incremental_mean(df, "k", ["at"], "x").collect()} == want
    assert folds.incremental_mean(df.limit(0), "k", ["at"], "x").count() == 0


def test_incremental_mean_of_one_hot_key(spark):
    """Two million rows of one key: batch after batch, with a count and a mean as state."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).cast("double").alias("x"))
    (row,) = folds.incremental_mean(df, "k", ["id"], "x").collect()
    assert row.n == 2_000_000
