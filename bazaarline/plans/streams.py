"""Batch twins of the streaming operators SM-02 to SM-10."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import sequences as seq
from ..sources import logs
from ..streaming import events as streams
from .base import EVENTS_AS_OF, clock, query, table, when_ts



def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", when_ts("ts"))


def _plain(df: DataFrame, *names: str) -> DataFrame:
    """Instants as zone-less timestamps, as SQL has them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("sm_02_message_ttl", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR AND event_type IN ('click', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    live = logs.live(_events(spark, d), "ts", clock(EVENTS_AS_OF), "48 HOURS").where(F.col("event_type").isin("click", "purchase"))
    return live.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select("event_id")


@query("sm_03_ttl_state", f"SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 36 HOUR QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, d):
    live = logs.live(_events(spark, d), "ts", clock(EVENTS_AS_OF), "36 HOURS")
    return dedup.first_per(live, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type")


@query(
    "sm_04_alert_counter",
    """WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
       s AS (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i) SELECT * FROM s WHERE streak = 3""",
)
def _(spark, d):
    error = F.col("event_type") == "error"
    return seq.running_streak(_events(spark, d), "user_id", ["ts", "event_id"], error, ~error).where("streak = 3").select("user_id", "event_id", "streak")


@query("sm_06_round_robin", "WITH b AS (SELECT DISTINCT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) // 6 AS batch FROM events), n AS (SELECT list(n_name ORDER BY n_nationkey) AS names FROM nation) SELECT batch, names[batch % len(names) + 1] AS country FROM b, n WHERE batch >= 0")
def _(spark, d):
    """The country that each batch of six hours is about."""
    hours = F.floor((F.unix_seconds("ts") - F.unix_seconds(clock("2024-01-01 00:00:00"))) / 3600)
    batches = _events(spark, d).select(F.floor(hours / 6).alias("batch")).where("batch >= 0").distinct()
    names = table(spark, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return batches.crossJoin(F.broadcast(names)).select("batch", streams.in_turn(F.col("batch"), F.col("names")).alias("country"))  # one row


@query("sm_08_daily_budget", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) <= 50")
def _(spark, d):
    rows = _events(spark, d).withColumn("k", F.row_number().over(Window.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id")))
    return rows.where("k <= 50").select("event_id")


@query("sm_10_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return _plain(streams.tumbling_counts(_events(spark, d), "ts", "event_type"), "start")


@query("sm_10_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(CAST(30 * k AS BIGINT)) AS start, count(*) AS n FROM events CROSS JOIN range(0, 2) t(k) GROUP BY 1")
def _(spark, d):
    return _plain(streams.sliding_counts(_events(spark, d), "ts"), "start")


@query(
    "sm_10_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def _(spark, d):
    return _plain(streams.sessions(_events(spark, d), "ts", "user_id"), "start", "end")
