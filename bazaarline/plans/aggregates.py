"""Aggregations AG-01 to AG-42 on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..functions.numbers import cents, js_round, mean_cents, median_mid, median_upper, share, variation
from ..operators import folds, stats
from ..operators.sequences import on_every_day
from .base import AS_OF, EVENTS_AS_OF, c, query, r2, table, when_ts

MEAN = f"CAST(sum({c('l_extendedprice')}) AS DOUBLE) / count(*) / 100"


@query("ag_01_mean", f"SELECT l_partkey, {MEAN} AS mean_price FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(mean_cents(F.col("l_extendedprice")).alias("mean_price"))


@query("ag_02_rounding", f"SELECT o_orderkey, {r2('o_totalprice * 0.13 - 5000')} AS fee, floor((o_totalprice * 0.13 - 5000) * 10 + 0.5) / 10 AS fee1, floor(o_totalprice * 0.13 - 5000 + 0.5) AS fee0 FROM orders")
def _(spark, d):
    x = F.col("o_totalprice") * 0.13 - 5000
    return table(spark, d, "orders").select("o_orderkey", js_round(x, 2).alias("fee"), js_round(x, 1).alias("fee1"), js_round(x, 0).alias("fee0"))


@query("ag_03_median_avg_of_two", f"SELECT l_partkey, {r2('median(l_extendedprice)')} AS median_price FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(js_round(median_mid(F.col("l_extendedprice")), 2).alias("median_price"))


@query("ag_04_median_upper", "SELECT l_partkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median_price FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(median_upper("l_extendedprice").alias("median_price"))


@query(
    "ag_05_median_else_mean",
    f"""SELECT p_brand, {r2(f"coalesce(median(CASE WHEN p_size > 45 THEN p_retailprice END), CAST(sum({c('p_retailprice')}) AS DOUBLE) / count(*) / 100)")} AS price
        FROM part GROUP BY p_brand""",
)
def _(spark, d):
    listed = F.when(F.col("p_size") > 45, F.col("p_retailprice"))
    return table(spark, d, "part").groupBy("p_brand").agg(js_round(F.coalesce(F.median(listed), mean_cents(F.col("p_retailprice"))), 2).alias("price"))


@query(
    "ag_06_conservative_price",
    f"""SELECT l_partkey, {r2('median(l_extendedprice)')} AS median_mid, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median_upper,
        {r2(f'least(median(l_extendedprice), {MEAN})')} AS conservative FROM lineitem GROUP BY l_partkey""",
)
def _(spark, d):
    return stats.medians_by(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice")


@query("ag_07_variation", "SELECT l_partkey, floor(CASE WHEN count(*) >= 2 THEN stddev_pop(l_extendedprice) / nullif(avg(l_extendedprice), 0) END * 10000 + 0.5) / 10000 AS cv FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return stats.variation_by(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice")


@query(
    "ag_08_positive_summary",
    f"""WITH p AS (SELECT l_partkey, CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END AS price FROM lineitem)
        SELECT l_partkey, coalesce(min(price) FILTER (price > 0), 0) AS min_price, coalesce(max(price) FILTER (price > 0), 0) AS max_price,
        coalesce({r2(f"CAST(sum({c('price')}) FILTER (price > 0) AS DOUBLE) / count(*) FILTER (price > 0) / 100")}, 0) AS avg_price FROM p GROUP BY l_partkey""",
)
def _(spark, d):
    prices = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("price"))
    return stats.price_summary(prices, "l_partkey", "price")


@query(
    "ag_09_price_details",
    """WITH p AS (SELECT l_partkey, CASE WHEN l_quantity >= 25 AND l_extendedprice <> 0 THEN l_extendedprice ELSE l_extendedprice * (1 + l_tax) END AS p FROM lineitem)
       SELECT l_partkey, count(*) AS n, min(p) AS min_price, max(p) AS max_price FROM p WHERE p > 0 GROUP BY l_partkey""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_quantity") >= 25, F.col("l_extendedprice")).otherwise(F.lit(0.0)).alias("price"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("total"))
    return stats.price_details(rows, "l_partkey", "price", "total")


@query(
    "ag_10_quartiles",
    f"""SELECT o_custkey, count(*) AS n, list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] AS q1,
        list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] AS q3, {r2(f"CAST(sum({c('o_totalprice')}) AS DOUBLE) / count(*) / 100")} AS mean,
        {r2('median(o_totalprice)')} AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_custkey HAVING count(*) >= 5""",
)
def _(spark, d):
    return stats.quartiles(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query(
    "ag_11_niche_stats",
    f"""WITH s AS (SELECT p_type AS niche, count(*) AS scanned FROM part GROUP BY p_type),
        h AS (SELECT p_type AS niche, count(*) AS opps, CAST(sum({c('l_extendedprice * l_discount')}) AS BIGINT) AS profit_cents FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.09 AND p_size > 10 GROUP BY p_type)
        SELECT coalesce(s.niche, h.niche) AS niche, coalesce(scanned, 0) AS scanned, coalesce(opps, 0) AS opps, coalesce(profit_cents, 0) AS profit_cents,
        coalesce({r2('CAST(profit_cents AS DOUBLE) / nullif(opps, 0) / 100')}, 0) AS avg_profit, coalesce({r2('CAST(coalesce(opps, 0) AS DOUBLE) * 100 / nullif(scanned, 0)')}, 0) AS success_rate
        FROM s FULL JOIN h ON s.niche = h.niche""",
)
def _(spark, d):
    part = table(spark, d, "part")
    scans = part.groupBy(F.col("p_type").alias("niche")).agg(F.count(F.lit(1)).alias("scanned"))
    sold = table(spark, d, "lineitem").where("l_discount >= 0.09").join(part.where("p_size > 10").select("p_partkey", F.col("p_type").alias("niche")), F.col("l_partkey") == F.col("p_partkey"))
    opps = sold.groupBy("niche").agg(F.count(F.lit(1)).alias("opps"), F.sum(cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("profit_cents"))
    both = scans.join(opps, "niche", "full")
    zero = F.lit(0).cast("long")
    both = both.select("niche", *[F.coalesce(x, zero).alias(x) for x in ("scanned", "opps", "profit_cents")])
    return both.withColumn("avg_profit", F.coalesce(js_round(share(F.col("profit_cents"), F.col("opps")) / 100, 2), F.lit(0.0))).withColumn("success_rate", F.coalesce(js_round(F.col("opps") * 100.0 / F.nullif(F.col("scanned"), F.lit(0)), 2), F.lit(0.0)))


@query("ag_12_count_by_platform", "SELECT event_type AS platform, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("platform")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_13_daily_profit", f"SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum({c('o_totalprice * 0.1')}) AS BIGINT) AS profit_cents, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def _(spark, d):
    daily = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(cents(F.col("o_totalprice") * 0.1)).alias("profit_cents"), F.count(F.lit(1)).alias("n"))
    return daily.orderBy(F.col("day").desc()).limit(30)


@query("ag_14_category_profit", f"SELECT o_orderpriority AS category, CAST(sum({c('o_totalprice * 0.1')}) AS BIGINT) AS profit_cents, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    out = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(F.sum(cents(F.col("o_totalprice") * 0.1)).alias("profit_cents"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("profit_cents").desc(), "category")


@query("ag_15_daily_scans", "SELECT CAST(ts AS DATE) AS day, count(*) AS scans, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS opportunities FROM events GROUP BY 1")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("scans"), F.sum(k).alias("opportunities"))


@query(
    "ag_16_accept_rates",
    f"""WITH g AS (SELECT source AS category, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality = 0) AS rejected FROM documents JOIN labels USING (doc_id) GROUP BY source)
        SELECT category, accepted, rejected, {r2('coalesce(CAST(accepted AS DOUBLE) / nullif(accepted + rejected, 0), 0) * 100')} AS rate,
        accepted + rejected >= 5 AND coalesce(CAST(accepted AS DOUBLE) / nullif(accepted + rejected, 0), 0) <= 0.1 AS problematic,
        accepted + rejected >= 20 AND coalesce(CAST(accepted AS DOUBLE) / nullif(accepted + rejected, 0), 0) <= 0.05 AS disable FROM g""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("category"))
    return stats.accept_rates(docs.join(table(spark, d, "labels"), "doc_id"), "category", F.col("quality") == 1, F.col("quality") == 0)


@query("ag_17_reason_frequency", f"WITH g AS (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1) SELECT reason, n, {r2('n * 100.0 / (SELECT count(*) FROM events)')} AS percent FROM g ORDER BY n DESC, reason LIMIT 5")
def _(spark, d):
    return stats.frequencies(table(spark, d, "events").withColumnRenamed("event_type", "reason"), "reason", top=5)


@query("ag_18_source_breakdown", "SELECT quality, count(*) FILTER (toxic = 1) AS by_model, count(*) FILTER (toxic = 0) AS manual FROM labels GROUP BY quality")
def _(spark, d):
    return stats.conditional_counts(table(spark, d, "labels"), ["quality"], {"by_model": F.col("toxic") == 1, "manual": F.col("toxic") == 0})


@query(
    "ag_19_total_profit",
    f"SELECT CAST(sum({c('o_totalprice * 0.1')}) AS BIGINT) AS profit_cents, {r2("count(*) FILTER (o_custkey % 100 >= 50) * 100.0 / nullif(count(*), 0)")} AS success_rate FROM orders WHERE o_orderstatus IN ('O', 'F')",
)
def _(spark, d):
    kept = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return kept.agg(F.sum(cents(F.col("o_totalprice") * 0.1)).alias("profit_cents"), js_round(F.count_if(F.col("o_custkey") % 100 >= 50) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("success_rate"))


@query(
    "ag_20_status_counts",
    """SELECT count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'P') AS candidate, count(*) FILTER (o_orderstatus = 'F') AS expired,
       count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice < 1000) AS small, count(*) AS every FROM orders""",
)
def _(spark, d):
    s = F.col("o_orderstatus")
    flags = {"active": s == "O", "candidate": s == "P", "expired": s == "F", "urgent": (s == "O") & (F.col("o_orderpriority") == "1-URGENT"), "small": F.col("o_totalprice") < 1000, "every": F.lit(True)}
    return stats.conditional_counts(table(spark, d, "orders"), [], flags)


@query("ag_21_turnover", f"SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS expired, {r2("CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*)")} AS ratio FROM events GROUP BY user_id")
def _(spark, d):
    out = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("expired"))
    return out.withColumn("ratio", js_round(share(F.col("expired"), F.col("total")), 2))


@query("ag_22_price_db_stats", f"SELECT p_type AS category, count(*) AS n, {r2(f"CAST(coalesce(sum({c('p_retailprice')}) FILTER (p_retailprice > 1000), 0) AS DOUBLE) / count(*) / 100")} AS avg_price FROM part GROUP BY p_type")
def _(spark, d):
    priced = F.when(F.col("p_retailprice") > 1000, cents(F.col("p_retailprice"))).otherwise(F.lit(0))
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), js_round(F.sum(priced).cast("double") / F.count(F.lit(1)) / 100, 2).alias("avg_price"))


@query(
    "ag_23_search_patterns",
    f"""WITH r AS (SELECT p_brand, l_extendedprice * (0.84 - l_discount * 10) - 4.5 AS profit FROM lineitem JOIN part ON l_partkey = p_partkey),
        g AS (SELECT p_brand, count(*) AS scanned, count(*) FILTER (profit > 0) AS hits, CAST(sum({c('profit')}) FILTER (profit > 0) AS DOUBLE) / count(*) FILTER (profit > 0) / 100 AS m, median(profit) FILTER (profit > 0) AS md, max(profit) FILTER (profit > 0) AS mx FROM r GROUP BY p_brand)
        SELECT p_brand AS search, scanned, CAST(hits AS DOUBLE) / scanned AS hit_rate, {r2('m')} AS avg_profit, {r2('md')} AS median_profit, {r2('mx')} AS max_profit FROM g""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("search")), F.col("l_partkey") == F.col("p_partkey"))
    profit = F.col("l_extendedprice") * (0.84 - F.col("l_discount") * 10) - 4.5
    won = F.when(profit > 0, profit)
    out = rows.groupBy("search").agg(F.count(F.lit(1)).alias("scanned"), F.count(won).alias("hits"), mean_cents(won).alias("m"), F.median(won).alias("md"), F.max(won).alias("mx"))
    hit = share(F.col("hits"), F.col("scanned"))
    out = out.select("search", "scanned", hit.alias("hit_rate"), js_round(F.col("m"), 2).alias("avg_profit"), js_round(F.col("md"), 2).alias("median_profit"), js_round(F.col("mx"), 2).alias("max_profit"))
    return out.orderBy((F.col("avg_profit") * F.col("hit_rate")).desc_nulls_last(), "search")


@query(
    "ag_24_keyword_weights",
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
       g AS (SELECT word, sum(CASE WHEN len(word) >= 8 THEN 2 ELSE 1 END) AS weight FROM w WHERE len(word) >= 3 AND word NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'les', 'des', 'der', 'die', 'das', 'los', 'las') GROUP BY word)
       SELECT word, CAST(weight AS BIGINT) AS weight FROM g ORDER BY weight DESC, word LIMIT 10""",
)
def _(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    stop = ("the", "and", "for", "that", "this", "with", "les", "des", "der", "die", "das", "los", "las")
    kept = words.where((F.length("word") >= 3) & ~F.col("word").isin(*stop))
    weights = kept.groupBy("word").agg(F.sum(F.when(F.length("word") >= 8, 2).otherwise(1)).alias("weight"))
    return weights.orderBy(F.col("weight").desc(), "word").limit(10)


@query(
    "ag_25_niche_scan_rates",
    """WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT DISTINCT event_type FROM events),
       n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) FILTER (value > 400) AS n FROM events GROUP BY 1, 2),
       f AS (SELECT s.day, t.event_type, coalesce(n.n, 0) AS n FROM s CROSS JOIN t LEFT JOIN n ON n.day = s.day AND n.event_type = t.event_type)
       SELECT event_type AS niche, count(*) AS scans, count(*) FILTER (n > 0) AS success, count(*) FILTER (n = 0) AS zero, CAST(sum(n) AS BIGINT) AS total, arg_max(n, day) AS last_count FROM f GROUP BY 1""",
)
def _(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("niche"), "value")
    counts = events.groupBy("day", "niche").agg(F.count_if(F.col("value") > 400).alias("n"))
    grid = on_every_day(events, "niche", "day")
    filled = grid.join(counts, ["day", "niche"], "left").fillna(0, ["n"])
    return filled.groupBy("niche").agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("n") > 0).alias("success"), F.count_if(F.col("n") == 0).alias("zero"), F.sum("n").alias("total"), F.max_by("n", "day").alias("last_count"))


@query("ag_26_distinct_list", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))


@query(
    "ag_27_portfolio_stats",
    f"""SELECT CAST(sum({c('o_totalprice')}) FILTER (o_orderstatus = 'O') AS BIGINT) AS invested_cents, CAST(sum({c('o_totalprice * 1.2')}) FILTER (o_orderstatus = 'O') AS BIGINT) AS value_cents,
        CAST(sum({c('o_totalprice * 1.2')} - {c('o_totalprice')}) FILTER (o_orderstatus = 'O') AS BIGINT) AS unrealised_cents, CAST(sum({c('o_totalprice * 0.1')}) FILTER (o_orderstatus = 'F') AS BIGINT) AS realised_cents,
        floor(CAST(sum({c('o_totalprice * 0.1')}) FILTER (o_orderstatus = 'F') AS DOUBLE) * 100 / sum({c('o_totalprice')}) FILTER (o_orderstatus = 'F') * 10 + 0.5) / 10 AS roi_percent FROM orders""",
)
def _(spark, d):
    held, sold = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    cost, value, won = cents(F.col("o_totalprice")), cents(F.col("o_totalprice") * 1.2), cents(F.col("o_totalprice") * 0.1)
    return table(spark, d, "orders").agg(
        F.sum(F.when(held, cost)).alias("invested_cents"),
        F.sum(F.when(held, value)).alias("value_cents"),
        F.sum(F.when(held, value - cost)).alias("unrealised_cents"),
        F.sum(F.when(sold, won)).alias("realised_cents"),
        js_round(F.sum(F.when(sold, won)).cast("double") * 100 / F.nullif(F.sum(F.when(sold, cost)), F.lit(0)), 1).alias("roi_percent"),
    )


@query(
    "ag_28_weekly_ledger",
    f"""SELECT o_custkey, CAST(coalesce(sum({c('o_totalprice')}) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) + 100000 AS total_cents,
        CAST(coalesce(sum({c('o_totalprice * 0.1')}) FILTER (o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 700 DAY AND o_orderstatus = 'F'), 0) AS BIGINT) AS recent_cents FROM orders GROUP BY o_custkey""",
)
def _(spark, d):
    since = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 700 DAYS")
    zero, held, sold = F.lit(0).cast("long"), F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        (F.coalesce(F.sum(F.when(held, cents(F.col("o_totalprice")))), zero) + 100000).alias("total_cents"),
        F.coalesce(F.sum(F.when(sold & (when_ts("o_orderdate") >= since), cents(F.col("o_totalprice") * 0.1))), zero).alias("recent_cents"),
    )


@query("ag_32_cache_health", "WITH p AS (SELECT * FROM pages ORDER BY page_id DESC LIMIT 50) SELECT CASE WHEN lower(html) LIKE '%captcha%' THEN 'blocked' WHEN length(html) < 2000 THEN 'empty' ELSE 'ok' END AS health, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    last = table(spark, d, "pages").orderBy(F.col("page_id").desc()).limit(50)
    health = F.when(F.lower("html").contains("captcha"), "blocked").when(F.length("html") < 2000, "empty").otherwise("ok")
    return last.groupBy(health.alias("health")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag_34_objective_plan",
    f"""WITH g AS (SELECT p_brand AS category, CAST(sum({c('p_retailprice * 0.1')}) AS BIGINT) AS monthly FROM part GROUP BY 1),
        r AS (SELECT *, CAST(sum(monthly) OVER (ORDER BY monthly DESC, category ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM g)
        SELECT category, monthly, running FROM r WHERE running - monthly < 500000""",
)
def _(spark, d):
    monthly = table(spark, d, "part").groupBy(F.col("p_brand").alias("category")).agg(F.sum(cents(F.col("p_retailprice") * 0.1)).alias("monthly"))
    order = Window.orderBy(F.col("monthly").desc(), "category").rowsBetween(Window.unboundedPreceding, 0)  # one row per category
    return monthly.withColumn("running", F.sum("monthly").over(order)).where(F.col("running") - F.col("monthly") < 500_000)


@query(
    "ag_36_sprint_rejects",
    f"""WITH e AS (SELECT user_id % 100 AS category, event_type AS reason, count(*) AS n FROM events WHERE value < 100 GROUP BY 1, 2),
        s AS (SELECT *, sum(n) OVER (PARTITION BY category) AS total FROM e)
        SELECT category, reason, n, CAST(n AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM s WHERE total >= 3 AND CAST(n AS DOUBLE) / CAST(total AS DOUBLE) > 0.25""",
)
def _(spark, d):
    rejects = table(spark, d, "events").where("value < 100").groupBy((F.col("user_id") % 100).alias("category"), F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("category"))  # reasons per category
    return rejects.withColumn("_t", total).withColumn("share", share(F.col("n"), F.col("_t"))).where("_t >= 3 AND share > 0.25").drop("_t")


@query("ag_37_recent_flags", f"SELECT user_id, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR) AS recent, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR) >= 2 AS flagged FROM events GROUP BY user_id")
def _(spark, d):
    recent = (F.col("event_type") == "click") & (when_ts("ts") >= F.lit(EVENTS_AS_OF).cast("timestamp") - F.expr("INTERVAL 48 HOURS"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(recent).alias("recent")).withColumn("flagged", F.col("recent") >= 2)


@query(
    "ag_38_incremental_mean",
    """WITH RECURSIVE s AS (SELECT l_partkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem),
       f AS (SELECT l_partkey, k, x AS m FROM s WHERE k = 1 UNION ALL SELECT s.l_partkey, s.k, floor((f.m * f.k + s.x) / (f.k + 1) * 100 + 0.5) / 100 FROM f JOIN s ON s.l_partkey = f.l_partkey AND s.k = f.k + 1)
       SELECT l_partkey, max(k) AS n, arg_max(m, k) AS daily_mean FROM f GROUP BY l_partkey""",
)
def _(spark, d):
    means = folds.incremental_mean(table(spark, d, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_extendedprice")
    return means.withColumnRenamed("mean", "daily_mean")


@query(
    "ag_41_best_similarity",
    """WITH n AS (SELECT vec_id, embedding AS v, [lead(embedding, 1) OVER w, lead(embedding, 2) OVER w, lead(embedding, 3) OVER w] AS sold FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
       s AS (SELECT vec_id, list_transform(list_filter(sold, lambda x: x IS NOT NULL), lambda x: list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(x AS DOUBLE[]))) AS s FROM n)
       SELECT vec_id, floor(list_max(s) * 100 + 0.5) AS best FROM s""",
)
def _(spark, d):
    """The best likeness of each picture to up to three that follow it in its label, as if they were its sales; null if there are none."""
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.array(*[F.lead("embedding", k).over(w) for k in (1, 2, 3)]).alias("sold"))
    return rows.select("vec_id", js_round(F.array_max(F.transform("sold", lambda x: cosine(F.col("v"), x))) * 100, 0).alias("best"))


@query(
    "ag_35_daily_digest",
    f"""WITH g AS (SELECT o_orderpriority AS category, count(*) AS n, CAST(sum({c('o_totalprice * 0.1')}) AS BIGINT) AS profit_cents FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT category, n, profit_cents, list_transform(list_slice(list_sort((SELECT list((-o_totalprice, o_orderkey)) FROM orders o WHERE o.o_orderstatus = 'O' AND o.o_orderpriority = g.category)), 1, 3), lambda x: x[2]) AS top FROM g""",
)
def _(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus = 'O'").withColumnRenamed("o_orderpriority", "category")
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    best = live.withColumn("_k", place).where("_k <= 3").groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("top"))
    totals = live.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("o_totalprice") * 0.1)).alias("profit_cents"))
    return totals.join(best, "category")
