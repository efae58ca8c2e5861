"""Window and sequence operators WN-01 to WN-15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, js_round, ladder, share, variation
from ..operators import sequences as seq
from .base import EVENTS_AS_OF, c, query, table, when_ts

SALES = ["l_shipdate", "l_orderkey", "l_linenumber"]
_XS = "WITH g AS (SELECT l_partkey, list(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS xs FROM lineitem GROUP BY l_partkey)"


def _mean(xs: str) -> str:
    return f"CASE WHEN len({xs}) > 0 THEN list_reduce(list_prepend(CAST(0 AS DOUBLE), {xs}), lambda a, b: a + b) / len({xs}) END"


def _sales(spark, d, first=0):
    return seq.ends(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", SALES, first=first).where("n >= 3")


@query(
    "wn_01_sale_intervals",
    """WITH i AS (SELECT l_partkey, (epoch_us(l_shipdate) - lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) / 86400000000.0 AS days FROM lineitem)
       SELECT l_partkey, count(*) AS n, count(*) FILTER (days > 0) AS n_positive, min(days) AS shortest, max(days) AS longest, floor(sum(days) / count(*) * 100 + 0.5) / 100 AS mean_days FROM i WHERE days >= 0 GROUP BY l_partkey""",
)
def _(spark, d):
    days = seq.intervals(table(spark, d, "lineitem"), "l_partkey", "l_shipdate", SALES[1:])
    x = F.col("days")
    return days.groupBy("l_partkey").agg(F.count(x).alias("n"), F.count_if(x > 0).alias("n_positive"), F.min(x).alias("shortest"), F.max(x).alias("longest"), js_round(F.sum(x) / F.count(x), 2).alias("mean_days"))


@query(
    "wn_02_trend_label",
    f"""{_XS}, h AS (SELECT l_partkey, xs, len(xs) AS n, list_slice(xs, -3, -1) AS last, CASE WHEN len(xs) >= 6 THEN list_slice(xs, len(xs) - 5, len(xs) - 3) ELSE list_slice(xs, 1, len(xs) - 3) END AS prev FROM g),
        t AS (SELECT l_partkey, n, CASE WHEN n >= 3 AND len(prev) > 0 THEN ({_mean('last')} - {_mean('prev')}) / nullif({_mean('prev')}, 0) END AS ch, CASE WHEN n >= 2 THEN list_stddev_pop(xs) / nullif(list_avg(xs), 0) END AS cv FROM h)
        SELECT l_partkey, CASE WHEN n < 3 THEN 'unknown' WHEN cv > 0.3 THEN 'volatile' WHEN ch > 0.1 THEN 'rising' WHEN ch < -0.1 THEN 'falling' ELSE 'stable' END AS trend FROM t""",
)
def _(spark, d):
    label, _ = seq.trend(F.col("last"), F.col("n"), 3, 0.10)
    cv = table(spark, d, "lineitem").groupBy("l_partkey").agg(variation(F.col("l_extendedprice")).alias("_cv"))
    rows = cv.join(_sales(spark, d), "l_partkey", "left")
    known = F.when(F.col("_cv") > 0.30, "volatile").otherwise(label)
    return rows.select("l_partkey", F.when(F.col("n").isNull(), "unknown").otherwise(known).alias("trend"))


@query(
    "wn_03_trend_strength",
    f"""{_XS}, h AS (SELECT l_partkey, len(xs) AS n, list_slice(xs, -3, -1) AS last, CASE WHEN len(xs) >= 6 THEN list_slice(xs, len(xs) - 5, len(xs) - 3) ELSE list_slice(xs, 1, len(xs) - 3) END AS prev FROM g)
        SELECT l_partkey, coalesce(floor(least(1.0, abs(CASE WHEN n >= 3 AND len(prev) > 0 THEN ({_mean('last')} - {_mean('prev')}) / nullif({_mean('prev')}, 0) END) / 0.5) * 100 + 0.5) / 100, 0) AS strength FROM h""",
)
def _(spark, d):
    _, change = seq.trend(F.col("last"), F.col("n"), 3, 0.10)
    keys = table(spark, d, "lineitem").select("l_partkey").distinct()
    return keys.join(_sales(spark, d), "l_partkey", "left").select("l_partkey", F.coalesce(js_round(F.least(F.lit(1.0), F.abs(change) / 0.5), 2), F.lit(0.0)).alias("strength"))


@query(
    "wn_04_first_last_trend",
    f"""{_XS}, h AS (SELECT l_partkey, len(xs) AS n, list_slice(xs, -3, -1) AS last, list_slice(xs, 1, 3) AS first FROM g WHERE len(xs) >= 5),
        t AS (SELECT l_partkey, n, ({_mean('last')} - {_mean('first')}) / nullif({_mean('first')}, 0) AS ch FROM h)
        SELECT l_partkey, n, CASE WHEN ch > 0.15 THEN 'rising' WHEN ch < -0.15 THEN 'falling' ELSE 'stable' END AS trend, CAST(floor(ch * 100 + 0.5) AS BIGINT) AS percent FROM t""",
)
def _(spark, d):
    label, change = seq.trend(F.col("last"), F.col("n"), 5, 0.15, F.col("first"))
    return _sales(spark, d, 3).where("n >= 5").select("l_partkey", "n", label.alias("trend"), seq.rounded_percent(change).alias("percent"))


@query(
    "wn_05_half_trend",
    f"""{_XS}, h AS (SELECT l_partkey, list_slice(xs, 1, len(xs) // 2) AS old, list_slice(xs, len(xs) // 2 + 1, len(xs)) AS new FROM g WHERE len(xs) >= 2),
        t AS (SELECT l_partkey, ({_mean('new')} - {_mean('old')}) / nullif({_mean('old')}, 0) AS ch FROM h)
        SELECT l_partkey, CASE WHEN ch > 0.05 THEN 'rising' WHEN ch < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM t""",
)
def _(spark, d):
    halves = seq.half_means(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", SALES)
    change = (F.col("new") - F.col("old")) / F.nullif("old", F.lit(0.0))
    return halves.where("n >= 2").select("l_partkey", F.when(change > 0.05, "rising").when(change < -0.05, "falling").otherwise("stable").alias("trend"))


@query(
    "wn_06_rolling_counts",
    f"""WITH g AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY) AS n30, count(*) FILTER (ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS n7 FROM events GROUP BY user_id)
        SELECT user_id, n30, n7, coalesce(CAST(n7 AS DOUBLE) / nullif(CAST(n30 AS DOUBLE), 0), 0) AS ratio, CASE WHEN coalesce(CAST(n7 AS DOUBLE) / nullif(CAST(n30 AS DOUBLE), 0), 0) > 0.4 THEN 'accelerating' WHEN coalesce(CAST(n7 AS DOUBLE) / nullif(CAST(n30 AS DOUBLE), 0), 0) < 0.2 THEN 'slowing' ELSE 'steady' END AS pace FROM g""",
)
def _(spark, d):
    now, ts = F.lit(EVENTS_AS_OF).cast("timestamp"), when_ts("ts")
    out = table(spark, d, "events").groupBy("user_id").agg(F.count_if(ts >= now - F.expr("INTERVAL 30 DAYS")).alias("n30"), F.count_if(ts >= now - F.expr("INTERVAL 7 DAYS")).alias("n7"))
    out = out.withColumn("ratio", F.coalesce(share(F.col("n7"), F.col("n30")), F.lit(0.0)))
    return out.withColumn("pace", ladder(F.col("ratio"), [(">", 0.4, "accelerating"), ("<", 0.2, "slowing")], "steady"))


_DAYS = """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT DISTINCT event_type FROM events),
       n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) FILTER (value > 470) AS n FROM events GROUP BY 1, 2),
       f AS (SELECT s.day, t.event_type, coalesce(n.n, 0) AS n, row_number() OVER (PARTITION BY t.event_type ORDER BY s.day DESC) AS k FROM s CROSS JOIN t LEFT JOIN n ON n.day = s.day AND n.event_type = t.event_type)"""


@query("wn_07_zero_streak", f"{_DAYS} SELECT event_type, coalesce(min(k) FILTER (n <> 0) - 1, count(*)) AS streak FROM f GROUP BY event_type")
def _(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    counts = events.groupBy("day", "event_type").agg(F.count_if(F.col("value") > 470).alias("n"))
    grid = seq.on_every_day(events, "event_type", "day").join(counts, ["day", "event_type"], "left").fillna(0, ["n"])
    return seq.zero_streak(grid, "event_type", ["day"], F.col("n") == 0)


@query(
    "wn_08_error_streak",
    """WITH i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
       s AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
       SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (streak = 3) AS alerts FROM s GROUP BY user_id""",
)
def _(spark, d):
    error = F.col("event_type") == "error"
    rows = seq.running_streak(table(spark, d, "events"), "user_id", ["ts", "event_id"], error, ~error)
    return rows.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("alerts"))


@query(
    "wn_09_failed_fixes",
    """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
       s AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM i)
       SELECT user_id, CAST(arg_max(streak, (ts, event_id)) AS BIGINT) AS failed, arg_max(streak, (ts, event_id)) >= 3 AS stop FROM s GROUP BY user_id""",
)
def _(spark, d):
    rows = seq.running_streak(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    return rows.groupBy("user_id").agg(F.max_by("streak", F.struct("ts", "event_id")).alias("failed")).withColumn("stop", F.col("failed") >= 3)


@query("wn_10_keep_last", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, d):
    return seq.keep_last(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id")


@query(
    "wn_11_tier_changes",
    f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, sum({c('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders),
        t AS (SELECT *, CASE WHEN total >= 300000000 THEN 4 WHEN total >= 200000000 THEN 3 WHEN total >= 100000000 THEN 2 ELSE 1 END AS state FROM r)
        SELECT o_custkey, o_orderkey, state FROM t QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "orders").withColumn("total", F.sum(cents(F.col("o_totalprice"))).over(w))
    tier = ladder(F.col("total"), [(">=", 300_000_000, 4), (">=", 200_000_000, 3), (">=", 100_000_000, 2)], 1)
    return seq.changes(rows, "o_custkey", ["o_orderdate", "o_orderkey"], tier).select("o_custkey", "o_orderkey", "state")


@query("wn_12_first_last_seen", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("wn_13_running_balance", f"SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN -{c('o_totalprice')} ELSE {c('o_totalprice')} END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("o_orderstatus") == "O", -cents(F.col("o_totalprice"))).otherwise(cents(F.col("o_totalprice")))
    return table(spark, d, "orders").select("o_orderkey", F.sum(signed).over(w).alias("balance"))


@query("wn_14_rank_in_category", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def _(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("wn_15_volatility_label", "WITH g AS (SELECT l_partkey, CASE WHEN count(*) >= 2 THEN stddev_pop(l_extendedprice) / nullif(avg(l_extendedprice), 0) END AS cv FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN cv > 0.3 THEN 'high' WHEN cv > 0.15 THEN 'medium' ELSE 'low' END AS volatility FROM g")
def _(spark, d):
    cv = table(spark, d, "lineitem").groupBy("l_partkey").agg(variation(F.col("l_extendedprice")).alias("cv"))
    return cv.select("l_partkey", seq.volatility_label(F.col("cv")).alias("volatility"))
