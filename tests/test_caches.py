"""Streams with state, stopped and started again, against plain folds over the same rows in order of time."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bazaarline.registry import QUERIES
from bazaarline.streaming import caches

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
BASE = datetime.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def write(spark, where, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(where)


def made(seed, n, minutes):
    """Rows whose order of arrival is up to an hour off; some have no time."""
    rng = random.Random(seed)
    rows = [(k, BASE + datetime.timedelta(minutes=rng.randint(0, minutes)), rng.randint(0, 3), rng.choice(["a", "b", "c"])) for k in range(n)]
    rows.sort(key=lambda r: r[1] + datetime.timedelta(minutes=rng.randint(0, 60)))
    rows[5] = (rows[5][0], None, 1, "a")
    return rows


def run(spark, tmp_path, rows, make, parts=4):
    """The stream over files that come one by one; a new query from the same checkpoint for each. A row far ahead lets the others pass."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    end = [(-1, BASE + datetime.timedelta(days=9000), -1, "end"), (-2, BASE + datetime.timedelta(days=9001), -1, "end")]
    step = -(-len(rows) // parts)
    for part in [rows[k : k + step] for k in range(0, len(rows), step)] + [end[:1], end[1:]]:
        write(spark, source, part)
        stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    return [r for r in spark.read.parquet(out).collect() if r["event_id"] >= 0]


def ms(t):
    return int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def test_seen_once(spark, tmp_path):
    rows, last, want = made(1, 240, 3000), {}, set()
    for event_id, ts, user, kind in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        if (user, kind) not in last or ts - last[user, kind] >= datetime.timedelta(hours=6):
            last[user, kind] = ts
            want.add((user, kind, event_id, ms(ts)))
    got = [tuple(r) for r in run(spark, tmp_path, rows, lambda s: caches.seen_once(s, "ts", ["user_id", "event_type"], 6, "2 hours"))]
    assert len(got) == len(want) > 30 and set(got) == want


def test_cached_prices(spark, tmp_path):
    """A cache for each user: two hours to live, two entries at most."""
    rows, held, want = made(2, 240, 1500), defaultdict(dict), set()
    for event_id, ts, user, kind in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        own = held[user] = {k: t for k, t in held[user].items() if ts - t < datetime.timedelta(hours=2)}
        hit = kind in own
        if not hit:
            if len(own) >= 2:
                own.clear()
            own[kind] = ts
        want.add((user, event_id, hit))
    got = [tuple(r) for r in run(spark, tmp_path, rows, lambda s: caches.cached_prices(s, "ts", "user_id", "event_type", 2, 2, "2 hours"))]
    assert len(got) == len(want) and set(got) == want and {h for *_, h in want} == {True, False}


def test_daily_budget_is_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rng = random.Random(3)
    rows = sorted(map(tuple, events.collect()), key=lambda r: r[1] + datetime.timedelta(minutes=rng.randint(0, 600)))
    got = [r["event_id"] for r in run(spark, tmp_path, rows, lambda s: caches.within_budget(s, "ts", "event_type", 50, "12 hours"))]
    assert sorted(got) == sorted(r["event_id"] for r in QUERIES["sm_08_daily_budget"](spark, SF).collect())


def test_daily_budget_is_spent(spark, tmp_path):
    rows = made(4, 200, 4000)
    days = defaultdict(list)
    for r in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        days[r[3], r[1].date()].append(r[0])
    want = sorted(i for own in days.values() for i in own[:5])
    got = [r["event_id"] for r in run(spark, tmp_path, rows, lambda s: caches.within_budget(s, "ts", "event_type", 5, "2 hours"))]
    assert sorted(got) == want and len(want) < 180


def test_rows_that_come_too_late_are_dropped(spark, tmp_path):
    early, late = (1, BASE + datetime.timedelta(hours=10), 1, "a"), (2, BASE, 1, "a")
    more = (3, BASE + datetime.timedelta(hours=11), 1, "a")
    got = [r["event_id"] for r in run(spark, tmp_path, [early, more, late], lambda s: caches.within_budget(s, "ts", "event_type", 5, "1 hour"), parts=3)]
    assert sorted(got) == [1, 3]
