"""Domain ladders and verdicts DM-04 to DM-31 on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, js_round, mean_cents, share, variation
from ..operators import dedup, matching, scores, signature
from ..operators import sequences as seq
from .base import AS_OF, c, query, r2, table, when_ts

MEAN = f"CAST(sum({c('l_extendedprice')}) AS DOUBLE) / count(*) / 100"
CV = "CASE WHEN count(*) >= 2 THEN stddev_pop(l_extendedprice) / nullif(avg(l_extendedprice), 0) END"


def _sales(spark, d) -> DataFrame:
    """Per part: catalogue price and statistics of its sales."""
    x = F.col("l_extendedprice")
    stats = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(x).alias("n"), mean_cents(x).alias("mean"), F.median(x).alias("median"), variation(x).alias("cv"))
    return table(spark, d, "part").join(stats, F.col("p_partkey") == F.col("l_partkey"))


_SALES = f"s AS (SELECT l_partkey, count(*) AS n, {MEAN} AS mean, median(l_extendedprice) AS median, {CV} AS cv FROM lineitem GROUP BY 1), p AS (SELECT * FROM part JOIN s ON p_partkey = l_partkey)"


@query(
    "dm_04_profit",
    f"""WITH {_SALES}, q AS (SELECT p_partkey, n, (CASE WHEN p_size > 25 THEN p_retailprice ELSE p_retailprice * 9 END) + 3.5 AS cost, mean * 0.84 - 4.5 AS net FROM p)
        SELECT p_partkey, {r2('cost')} AS total_cost, {r2('net')} AS net_sale, {r2('net - cost')} AS profit, floor((net - cost) / cost * 100 + 0.5) AS percent, CASE WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS reliability FROM q""",
)
def _(spark, d):
    buyer = F.when(F.col("p_size") > 25, F.col("p_retailprice")).otherwise(F.lit(0.0))
    rows = _sales(spark, d).withColumn("cost", scores.total_cost(buyer, F.col("p_retailprice") * 9)).withColumn("net", scores.net_sale(F.col("mean")))
    profit = F.col("net") - F.col("cost")
    return rows.select("p_partkey", js_round(F.col("cost"), 2).alias("total_cost"), js_round(F.col("net"), 2).alias("net_sale"), js_round(profit, 2).alias("profit"), js_round(profit / F.col("cost") * 100, 0).alias("percent"), scores.reliability(F.col("n")).alias("reliability"))


@query(
    "dm_05_detailed_profit",
    f"WITH {_SALES} SELECT p_partkey, {r2('least(median, mean) * (1 - (CAST(0.13 AS DOUBLE) + CAST(0.03 AS DOUBLE) + CAST(0.02 AS DOUBLE))) - 0.3 - 4.5')} AS ebay_net, {r2('least(median, mean) * (1 - (CAST(0.05 AS DOUBLE) + CAST(0.03 AS DOUBLE))) - 4.5')} AS cardmarket_net FROM p",
)
def _(spark, d):
    price = F.least("median", "mean")
    return _sales(spark, d).select("p_partkey", js_round(scores.detailed_net(price, "ebay"), 2).alias("ebay_net"), js_round(scores.detailed_net(price, "cardmarket"), 2).alias("cardmarket_net"))


@query(
    "dm_06_confidence",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS ms, l_suppkey % 2 = 0 AS e, CASE l_suppkey % 5 WHEN 0 THEN 'niche-api' WHEN 1 THEN 'browse-api' WHEN 2 THEN 'ebay' WHEN 3 THEN 'local-db' ELSE 'stale' END AS src, l_linenumber AS n,
         CASE l_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'false' END AS verdict, l_discount * 1000 AS g, l_tax * 12 AS img, l_returnflag <> 'R' AS cmp, l_linestatus = 'O' AS used, l_partkey % 100 AS seller FROM lineitem),
       a AS (SELECT *, CASE WHEN ms >= 12 THEN 40 WHEN ms >= 8 AND e THEN 40 WHEN ms >= 8 THEN 30 WHEN ms >= 4 AND e THEN 25 WHEN ms >= 4 THEN 20 ELSE 10 END AS t,
         CASE src WHEN 'niche-api' THEN 20 WHEN 'browse-api' THEN CASE WHEN n >= 3 THEN 20 ELSE 10 END WHEN 'ebay' THEN CASE WHEN n >= 3 THEN 15 ELSE 8 END WHEN 'local-db' THEN CASE WHEN n >= 3 THEN 15 WHEN n >= 2 THEN 10 ELSE 5 END ELSE 3 END AS s0,
         CASE verdict WHEN 'true' THEN floor(25 + (least(greatest(g, 60), 100) - 60) * 25 / 40 + 0.5) WHEN 'uncertain' THEN floor(10 + (least(greatest(g, 20), 55) - 20) * 15 / 35 + 0.5) ELSE CASE WHEN img >= 0.85 THEN 25 WHEN img >= 0.75 THEN 15 ELSE 0 END END AS v0 FROM o),
       b AS (SELECT *, CASE WHEN n = 1 THEN greatest(0, s0 - 10) ELSE s0 END AS s1 FROM a),
       d AS (SELECT *, CASE WHEN verdict IS NOT NULL AND NOT cmp THEN floor(v0 / 2) ELSE v0 END AS v, CASE WHEN verdict IS NOT NULL AND NOT cmp AND used THEN greatest(0, s1 - 10) ELSE s1 END AS s FROM b),
       f AS (SELECT *, greatest(0, least(100, t + s + v) + CASE WHEN l_linenumber = 4 THEN -30 ELSE 0 END) AS c1 FROM d),
       h AS (SELECT *, CASE WHEN seller < 20 THEN least(c1, 40) ELSE c1 END AS c2 FROM f),
       i AS (SELECT *, CASE WHEN n < 2 AND src <> 'niche-api' THEN least(c2, 45) ELSE c2 END AS c3 FROM h)
       SELECT l_orderkey, l_linenumber, CAST(CASE WHEN verdict = 'false' THEN 0 WHEN NOT (coalesce(verdict = 'true', FALSE) OR (t >= 30 AND s >= 15 AND v >= 15)) THEN least(c3, 59) ELSE c3 END AS BIGINT) AS confidence FROM i""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_suppkey") % 5
    src = F.when(k == 0, "niche-api").when(k == 1, "browse-api").when(k == 2, "ebay").when(k == 3, "local-db").otherwise("stale")
    p = F.col("l_partkey") % 4
    rows = li.withColumn("src", src).withColumn("verdict", F.when(p == 0, "true").when(p == 1, "uncertain").when(p == 2, "false")).withColumn("n", F.col("l_linenumber"))
    rows = rows.withColumn("t", scores.text_points(F.col("l_quantity"), F.col("l_suppkey") % 2 == 0)).withColumn("s", scores.source_points(F.col("src"), F.col("n"))).withColumn("v", scores.vision_points(F.col("verdict"), F.col("l_discount") * 1000, F.col("l_tax") * 12))
    out = scores.confidence(F.col("t"), F.col("s"), F.col("v"), F.col("verdict"), F.col("l_returnflag") != "R", F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") == 4, -30), F.col("l_partkey") % 100, F.col("n"), F.col("src") == "niche-api")
    return rows.select("l_orderkey", "l_linenumber", out.alias("confidence"))


_LIQ = f"""WITH i AS (SELECT l_partkey, l_extendedprice, l_returnflag, (epoch_us(l_shipdate) - lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) / 86400000000.0 AS days FROM lineitem),
       g AS (SELECT l_partkey, count(*) AS n, {CV} AS cv, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS ratio, floor(sum(days) / nullif(count(days), 0) * 100 + 0.5) / 100 AS iv FROM i GROUP BY 1),
       s AS (SELECT *, CASE WHEN n <= 0 THEN 0 WHEN n <= 2 THEN 15 WHEN n <= 5 THEN 30 WHEN n <= 10 THEN 60 WHEN n <= 20 THEN 80 ELSE 100 END AS vol, CASE WHEN n < 2 THEN 50 WHEN iv IS NULL THEN 100 WHEN iv < 1 THEN 100 WHEN iv < 3 THEN 80 WHEN iv < 7 THEN 60 WHEN iv < 14 THEN 40 ELSE 20 END AS spd,
         CASE WHEN cv IS NULL THEN 50 WHEN cv < 0.1 THEN 100 WHEN cv < 0.2 THEN 80 WHEN cv < 0.3 THEN 60 WHEN cv < 0.5 THEN 40 ELSE 20 END AS stb, CASE WHEN n >= 3 THEN CASE WHEN ratio >= 0.7 THEN 100 WHEN ratio >= 0.5 THEN 80 WHEN ratio >= 0.3 THEN 60 WHEN ratio >= 0.1 THEN 40 ELSE 20 END ELSE 50 END AS trn FROM g)"""


def _liquidity(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    stats = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), variation(F.col("l_extendedprice")).alias("cv"), share(F.count_if(F.col("l_returnflag") == "R"), F.count(F.lit(1))).alias("ratio"))
    gaps = seq.intervals(li, "l_partkey", "l_shipdate", ["l_orderkey", "l_linenumber"]).groupBy("l_partkey").agg(js_round(F.sum("days") / F.count("days"), 2).alias("iv"))
    rows = stats.join(gaps, "l_partkey", "left")
    parts = scores.volume_step(F.col("n")), scores.speed_step(F.col("n"), F.col("iv")), scores.stability_step(F.col("cv")), scores.turnover_step(F.col("ratio"), F.col("n"))
    return rows.withColumn("score", scores.liquidity(*parts))


@query("dm_07_liquidity", f"{_LIQ}, z AS (SELECT l_partkey, CAST(floor(vol * 0.35 + spd * 0.30 + stb * 0.20 + trn * 0.15 + 0.5) AS BIGINT) AS score FROM s) SELECT l_partkey, score, CASE WHEN score >= 80 THEN 'very_high' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'very_low' END AS tier FROM z")
def _(spark, d):
    return _liquidity(spark, d).select("l_partkey", "score", scores.five_tiers(F.col("score")).alias("tier"))


@query(
    "ag_29_liquidity_summary",
    f"{_LIQ}, z AS (SELECT CAST(floor(vol * 0.35 + spd * 0.30 + stb * 0.20 + trn * 0.15 + 0.5) AS BIGINT) AS score FROM s) SELECT count(*) AS n, {r2('CAST(sum(score) AS DOUBLE) / count(*)')} AS avg_score, count(*) FILTER (score >= 60) AS high, count(*) FILTER (score >= 40 AND score < 60) AS medium, count(*) FILTER (score < 40) AS low FROM z",
)
def _(spark, d):
    s = F.col("score")
    return _liquidity(spark, d).agg(F.count(s).alias("n"), js_round(F.sum(s).cast("double") / F.count(s), 2).alias("avg_score"), F.count_if(s >= 60).alias("high"), F.count_if((s >= 40) & (s < 60)).alias("medium"), F.count_if(s < 40).alias("low"))


@query(
    "dm_08_evaluate",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount / 100 AS profit, l_discount * 500 AS pct, l_quantity * 2 AS conf, l_tax * 1000 AS liq, l_linenumber AS obs, CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'R' THEN 'false' END AS vision FROM lineitem),
       f AS (SELECT *, list_filter([CASE WHEN profit < 15 THEN 'profit' END, CASE WHEN pct < 20 THEN 'percent' END, CASE WHEN conf < 30 THEN 'confidence' END, CASE WHEN liq < 30 THEN 'liquidity' END, CASE WHEN obs < 2 THEN 'price' END], lambda x: x IS NOT NULL) AS failing FROM o)
       SELECT l_orderkey, l_linenumber, array_to_string(failing, ',') AS failing, CASE WHEN len(failing) > 0 THEN 'reject' WHEN vision = 'true' THEN 'active' WHEN vision = 'false' THEN 'rejected' ELSE 'pending' END AS verdict FROM f""",
)
def _(spark, d):
    checks = {"profit": F.col("l_extendedprice") * F.col("l_discount") / 100 < 15, "percent": F.col("l_discount") * 500 < 20, "confidence": F.col("l_quantity") * 2 < 30, "liquidity": F.col("l_tax") * 1000 < 30, "price": F.col("l_linenumber") < 2}
    failing = F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))
    flag = F.col("l_returnflag")
    verdict = F.when(F.size("f") > 0, "reject").when(flag == "A", "active").when(flag == "R", "rejected").otherwise("pending")
    return table(spark, d, "lineitem").withColumn("f", failing).select("l_orderkey", "l_linenumber", F.array_join("f", ",").alias("failing"), verdict.alias("verdict"))


@query(
    "dm_09_vision_verdict",
    """WITH o AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'uncertain' END AS p, CASE event_id % 2 WHEN 0 THEN 'true' ELSE 'uncertain' END AS v, event_type <> 'error' AS cond, CASE WHEN value < 400 THEN value / 4 END AS g FROM events),
       d AS (SELECT *, CASE WHEN p = 'false' OR v = 'false' THEN 'false' WHEN p = 'true' AND v = 'true' THEN 'true' ELSE 'uncertain' END AS verdict FROM o)
       SELECT event_id, verdict, CASE verdict WHEN 'false' THEN 0.0 WHEN 'true' THEN CASE WHEN cond THEN least(greatest(coalesce(g, 90.0), 60.0), 100.0) ELSE least(greatest(coalesce(g, 60.0), 40.0), 70.0) END ELSE least(greatest(coalesce(g, 45.0), 20.0), 55.0) END AS confidence FROM d""",
)
def _(spark, d):
    k = F.col("user_id") % 3
    product, variant = F.when(k == 0, "true").when(k == 1, "false").otherwise("uncertain"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("uncertain")
    verdict, confidence = scores.vision_verdict(product, variant, F.col("event_type") != "error", F.when(F.col("value") < 400, F.col("value") / 4))
    return table(spark, d, "events").select("event_id", verdict.alias("verdict"), confidence.alias("confidence"))


@query(
    "dm_10_seller_score",
    """WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) / 10000 END AS rep, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey * 3 END AS fb, s_nationkey AS it FROM supplier)
       SELECT s_suppkey, CAST(floor(coalesce(rep, 0.5) * 100 * 0.4 + (CASE WHEN coalesce(fb, 0) <= 0 THEN 10 WHEN fb <= 5 THEN 30 WHEN fb <= 20 THEN 50 WHEN fb <= 50 THEN 70 ELSE 90 END) * 0.3 + (CASE WHEN it <= 0 THEN 10 WHEN it <= 5 THEN 30 WHEN it <= 20 THEN 60 ELSE 90 END) * 0.3 + 0.5) AS BIGINT) AS score FROM o""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    score = scores.seller_score(F.when(key % 7 != 0, F.abs("s_acctbal") / 10000), F.when(key % 5 != 0, F.col("s_nationkey") * 3), F.col("s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", score.alias("score"))


@query(
    "dm_11_underpriced",
    f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, count(*) OVER (PARTITION BY l_partkey) AS n, l_partkey FROM lineitem),
        m AS (SELECT l_partkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS med FROM lineitem GROUP BY 1)
        SELECT l_orderkey, l_linenumber, n, med AS median_price, {r2('1 - x / med')} AS discount FROM w JOIN m USING (l_partkey) WHERE n >= 3 AND 1 - x / med >= 0.5""",
)
def _(spark, d):
    from ..functions.numbers import median_upper

    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    groups = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), median_upper("l_extendedprice").alias("median_price")).where("n >= 3")
    discount = 1 - F.col("l_extendedprice") / F.col("median_price")
    found = li.join(groups, "l_partkey").where(discount >= 0.5)
    return found.select("l_orderkey", "l_linenumber", "n", "median_price", js_round(discount, 2).alias("discount")).orderBy(F.col("discount").desc(), "l_orderkey", "l_linenumber")


@query(
    "dm_12_agent_liquidity",
    """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n30, count(*) FILTER (event_type = 'purchase' AND value > 250) AS n7, CAST(min(value) AS DOUBLE) AS dd, count(*) AS n, CASE WHEN count(*) >= 2 THEN floor(stddev_pop(value) / avg(value) * 100 + 0.5) END AS c FROM events GROUP BY 1)
       SELECT user_id, floor((CASE WHEN n30 >= 10 THEN 100.0 WHEN n30 >= 6 THEN 75 + (n30 - 6) * 6.25 WHEN n30 >= 3 THEN 40 + (n30 - 3) * CAST(11.67 AS DOUBLE) WHEN n30 >= 1 THEN 10 + (n30 - 1) * 15.0 ELSE 0 END) * 100 + 0.5) / 100 AS volume,
       floor((CASE WHEN dd <= 0.5 THEN 100.0 WHEN dd <= 2 THEN 85 + (2 - dd) * 10 WHEN dd <= 7 THEN 55 + (7 - dd) / 5 * 30 WHEN dd <= 14 THEN 25 + (14 - dd) / 7 * 30 WHEN dd <= 30 THEN 5 + (30 - dd) / 16 * 20 WHEN dd <= 60 THEN (60 - dd) / 30 * 5 ELSE 0 END) * 100 + 0.5) / 100 AS speed,
       floor(coalesce(CASE WHEN c <= 10 THEN 90 + (10 - c) WHEN c <= 15 THEN 70 + (15 - c) / 5 * 20 WHEN c <= 25 THEN 40 + (25 - c) / 10 * 30 WHEN c <= 40 THEN 10 + (40 - c) / 15 * 30 WHEN c > 40 THEN greatest(0, 10 - (c - 40) / 5) END, 50) * 100 + 0.5) / 100 AS stability,
       CASE WHEN dd <= 2 THEN 'flash' WHEN dd <= 7 THEN 'fast' WHEN dd <= 14 THEN 'normal' WHEN dd <= 30 THEN 'slow' ELSE 'very_slow' END AS tier FROM g""",
)
def _(spark, d):
    bought = F.col("event_type") == "purchase"
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(bought).alias("n30"), F.count_if(bought & (F.col("value") > 250)).alias("n7"), F.min("value").alias("dd"), js_round(variation(F.col("value")) * 100, 0).alias("c"))
    zero = F.lit(0.0)
    return g.select("user_id", js_round(scores.agent_volume(F.col("n30"), zero, F.col("n7")), 2).alias("volume"), js_round(scores.agent_speed(F.col("dd")), 2).alias("speed"), js_round(scores.agent_stability(F.col("c"), F.lit("stable")), 2).alias("stability"), scores.speed_tier(F.col("dd")).alias("tier"))


@query(
    "dm_13_supervisor_confidence",
    f"""SELECT l_orderkey, l_linenumber, {r2("25 * CASE WHEN l_linenumber >= 3 THEN 1.0 WHEN l_linenumber >= 2 THEN 0.7 ELSE 0.3 END + 20 * l_discount * 10 + 20 * greatest(0, 1 - 2 * l_tax) + 20 * least(1.0, (l_quantity - 5) / 15) + 5 * l_tax + 15 * CASE WHEN l_quantity >= 50 THEN 1.0 WHEN l_quantity >= 30 THEN 0.7 ELSE 0.4 END")} AS confidence FROM lineitem""",
)
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", js_round(scores.supervisor_confidence(F.col("l_linenumber"), F.col("l_discount") * 10, F.col("l_tax"), q, F.col("l_tax"), q), 2).alias("confidence"))


@query(
    "dm_14_supervise",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus <> 'O' THEN 'expired' WHEN l_discount - 0.02 <= 0 THEN 'rejected' WHEN l_quantity < 30 THEN 'low_confidence' ELSE 'confirmed' END AS verdict FROM lineitem",
)
def _(spark, d):
    verdict = scores.supervise(F.col("l_linestatus") == "O", F.col("l_discount") - 0.02, F.col("l_quantity"), F.lit(30))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query(
    "dm_15_border_colour",
    """WITH v AS (SELECT vec_id, CAST(floor((CAST(embedding[1] AS DOUBLE) + 1) * 127) AS BIGINT) AS r, CAST(floor((CAST(embedding[2] AS DOUBLE) + 1) * 127) AS BIGINT) AS g, CAST(floor((CAST(embedding[3] AS DOUBLE) + 1) * 127) AS BIGINT) AS b FROM embeddings)
       SELECT vec_id, CASE WHEN (r + g + b) / 3.0 < 45 THEN 'black' WHEN (r + g + b) / 3.0 > 185 AND greatest(r, g, b) - least(r, g, b) < 35 THEN 'silver' WHEN r > 140 AND g > 110 AND b < 95 AND greatest(r, g, b) - least(r, g, b) > 55 AND r >= g * 0.92 THEN 'gold'
       WHEN r > 120 AND r > g * 1.5 AND r > b * 1.4 THEN 'red' WHEN b > 100 AND b > r * 1.25 AND b >= g THEN 'blue' WHEN g > 100 AND g > r * 1.2 AND g > b * 1.15 THEN 'green' WHEN r > 70 AND b > 70 AND g < r * 0.75 AND g < b * 0.75 AND greatest(r, g, b) - least(r, g, b) > 30 THEN 'purple' ELSE 'other' END AS colour FROM v""",
)
def _(spark, d):
    r, g, b = (F.floor((F.col("embedding")[k].cast("double") + 1) * 127) for k in range(3))
    return table(spark, d, "embeddings").select("vec_id", scores.border_colour(r, g, b).alias("colour"))


@query(
    "dm_16_price_routing",
    f"""WITH u AS (SELECT p_partkey, 0 AS priority, 'catalogue' AS source, p_retailprice AS price FROM part WHERE p_size > 40 UNION ALL
        SELECT l_partkey, 1, 'sales', {r2('median(l_extendedprice)')} FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1 UNION ALL SELECT p_partkey, 2, 'fallback', p_retailprice * 2 FROM part)
        SELECT p_partkey, source, price FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY priority) = 1""",
)
def _(spark, d):
    part = table(spark, d, "part")
    sources = [
        part.where("p_size > 40").select("p_partkey", F.lit(0).alias("priority"), F.lit("catalogue").alias("source"), F.col("p_retailprice").alias("price")),
        table(spark, d, "lineitem").where("l_discount >= 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(js_round(F.median("l_extendedprice"), 2).alias("price")).select("p_partkey", F.lit(1).alias("priority"), F.lit("sales").alias("source"), "price"),
        part.select("p_partkey", F.lit(2).alias("priority"), F.lit("fallback").alias("source"), (F.col("p_retailprice") * 2).alias("price")),
    ]
    every = sources[0].unionByName(sources[1]).unionByName(sources[2])
    return dedup.first_per(every, ["p_partkey"], ["priority"]).select("p_partkey", "source", "price")


@query("dm_17_market_price", f"SELECT l_partkey, {r2('median(l_extendedprice)')} AS price, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1")
def _(spark, d):
    out = table(spark, d, "lineitem").where("l_discount >= 0.08").groupBy("l_partkey").agg(js_round(F.median("l_extendedprice"), 2).alias("price"), F.count(F.lit(1)).alias("n"))
    return out.select("l_partkey", "price", scores.reliability(F.col("n")).alias("confidence"))


@query(
    "dm_18_reverse_arbitrage",
    f"""WITH m AS (SELECT l_partkey, count(*) AS n, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS med FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
        SELECT p_partkey, {r2('0.95 * med - 4 - 5')} AS max_buy, {r2('0.95 * med - 4 - p_retailprice * 20')} AS profit FROM part JOIN m ON p_partkey = l_partkey WHERE 0.95 * med - 4 - 5 >= 2 AND 0.95 * med - 4 - p_retailprice * 20 >= 5 AND (0.95 * med - 4 - p_retailprice * 20) / (p_retailprice * 20) >= 0.2""",
)
def _(spark, d):
    from ..functions.numbers import median_upper

    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), median_upper("l_extendedprice").alias("med")).where("n >= 3")
    rows = table(spark, d, "part").join(m, "p_partkey")
    most, ask = 0.95 * F.col("med") - 4 - 5, F.col("p_retailprice") * 20
    profit = 0.95 * F.col("med") - 4 - ask
    return rows.where((most >= 2) & (profit >= 5) & (profit / ask >= 0.2)).select("p_partkey", js_round(most, 2).alias("max_buy"), js_round(profit, 2).alias("profit"))


@query(
    "dm_19_cross_market",
    f"WITH {_SALES}, q AS (SELECT p_partkey, p_retailprice * 15 + 2 AS cost, mean * 0.87 - 4.5 AS net FROM p) SELECT p_partkey, {r2('net - cost')} AS profit, CASE WHEN net - cost >= 8 AND (net - cost) / cost >= 0.05 THEN 'strong' ELSE 'weak' END AS grade FROM q WHERE net - cost >= 5 AND (net - cost) / cost >= 0.03",
)
def _(spark, d):
    cost, net = F.col("p_retailprice") * 15 + 2, F.col("mean") * 0.87 - 4.5
    profit = net - cost
    rows = _sales(spark, d).where((profit >= 5) & (profit / cost >= 0.03))
    return rows.select("p_partkey", js_round(profit, 2).alias("profit"), F.when((profit >= 8) & (profit / cost >= 0.05), "strong").otherwise("weak").alias("grade"))


@query(
    "dm_20_category_ranking",
    f"""WITH g AS (SELECT p_type AS category, CAST(sum({c('p_retailprice')}) AS DOUBLE) / count(*) / 100 AS buy, CAST(count(*) AS DOUBLE) AS volume, CAST(max(p_size) AS DOUBLE) AS risk FROM part GROUP BY 1),
        m AS (SELECT *, least((buy * 1.4 - buy) / buy * 100 / 2, 30) + least(volume / 100, 10) * 2 + 5 * 2 - least(risk / 10, 5) * 1.5 - 2 * 1.5 AS s FROM g)
        SELECT category, floor(s * 10 + 0.5) / 10 AS score, row_number() OVER (ORDER BY floor(s * 10 + 0.5) / 10 DESC, category) AS rank FROM m WHERE buy <= 5000 * 0.4""",
)
def _(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(mean_cents(F.col("p_retailprice")).alias("buy"), F.count(F.lit(1)).cast("double").alias("volume"), F.max("p_size").cast("double").alias("risk"))
    margin = (F.col("buy") * 1.4 - F.col("buy")) / F.col("buy") * 100
    score = F.least(margin / 2, F.lit(30)) + F.least(F.col("volume") / 100, F.lit(10)) * 2 + 5 * 2 - F.least(F.col("risk") / 10, F.lit(5)) * 1.5 - 2 * 1.5
    rows = g.where(F.col("buy") <= 5000 * 0.4).select("category", js_round(score, 1).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "category")).cast("long"))  # one row per category


@query(
    "dm_22_niche_health",
    """WITH g AS (SELECT event_type AS niche, user_id % 20 AS k, count(*) AS scans, count(*) FILTER (value > 250) AS good, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS listings, count(*) FILTER (value > 480) AS opps FROM events GROUP BY 1, 2)
       SELECT niche, k, CAST(floor((CASE WHEN k % 6 >= 5 THEN 0.5 ELSE 1.0 END) * (40 * (CAST(good AS DOUBLE) / scans) + CASE WHEN CAST(listings AS DOUBLE) / scans >= 50 THEN 20 WHEN CAST(listings AS DOUBLE) / scans >= 20 THEN 15 WHEN CAST(listings AS DOUBLE) / scans >= 5 THEN 10 WHEN listings > 0 THEN 5 ELSE 0 END + least(20, 4 * opps) + CASE WHEN k % 3 = 2 THEN 20 WHEN k % 3 = 1 THEN 10 WHEN k % 2 = 0 THEN 5 ELSE 0 END) + 0.5) AS BIGINT) AS health FROM g""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("niche"), (F.col("user_id") % 20).alias("k")).agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("value") > 250).alias("good"), F.sum(k).alias("listings"), F.count_if(F.col("value") > 480).alias("opps"))
    health = scores.niche_health(share(F.col("good"), F.col("scans")), share(F.col("listings"), F.col("scans")), F.col("opps"), F.col("k") % 3, F.col("k") % 2 == 0, F.col("k") % 6)
    return g.select("niche", "k", health.alias("health"))


@query(
    "dm_24_strategist",
    """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS price, o_custkey % 100 AS margin, CASE WHEN o_custkey % 9 <> 0 THEN o_orderkey % 100 END AS liq, o_totalprice / 20000 AS profit, o_orderpriority = '1-URGENT' AS bonus, (o_custkey % 7) * 1000.0 AS value FROM orders),
       t AS (SELECT *, CASE WHEN value >= 5000 THEN 500 WHEN value >= 2500 THEN 150 WHEN value >= 1000 THEN 50 ELSE 20 END AS most, CASE WHEN value >= 5000 THEN 30 WHEN value >= 2500 THEN 35 WHEN value >= 1000 THEN 40 ELSE 50 END AS target FROM o),
       s AS (SELECT *, CASE WHEN margin >= 80 THEN 40 WHEN margin >= target THEN 30 WHEN margin >= 15 THEN 15 ELSE 5 END + CASE WHEN liq IS NULL THEN 0 WHEN liq >= 80 THEN 10 WHEN liq >= 60 THEN 7 WHEN liq >= 40 THEN 3 ELSE -5 END
         + CASE WHEN price / most <= 0.3 THEN 20 WHEN price / most <= 0.6 THEN 15 WHEN price / most <= 0.8 THEN 10 ELSE 5 END + CASE WHEN profit >= 20 THEN 20 WHEN profit >= 10 THEN 15 WHEN profit >= 5 THEN 10 ELSE 5 END + CASE WHEN bonus THEN 10 ELSE 0 END
         + CASE WHEN price / (value + 100) > 0.8 THEN -25 WHEN price / (value + 100) > 0.5 THEN -10 ELSE 0 END AS score FROM t)
       SELECT o_orderkey, score, CASE WHEN price > value + 100 OR price > most THEN 'skip' WHEN score >= 70 THEN 'buy' WHEN score >= 45 THEN 'consider' WHEN score >= 25 THEN 'wait' ELSE 'skip' END AS verdict FROM s""",
)
def _(spark, d):
    value, price = (F.col("o_custkey") % 7) * 1000.0, F.col("o_totalprice") / 1000
    available = value + 100
    most, target = scores.capital_tier(value, 2), scores.capital_tier(value, 3)
    score = scores.strategist_score(F.col("o_custkey") % 100, target, F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderkey") % 100), price, most, F.col("o_totalprice") / 20000, F.col("o_orderpriority") == "1-URGENT", available)
    verdict = F.when((price > available) | (price > most), "skip").when(F.col("score") >= 70, "buy").when(F.col("score") >= 45, "consider").when(F.col("score") >= 25, "wait").otherwise("skip")
    rows = table(spark, d, "orders").withColumn("score", score)
    return rows.select("o_orderkey", "score", verdict.alias("verdict"))


@query(
    "dm_25_settlement",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS p, CASE o_custkey % 5 WHEN 0 THEN 'ebay' WHEN 1 THEN 'vinted' WHEN 2 THEN 'cardmarket' WHEN 3 THEN 'leboncoin' ELSE 'other' END AS platform FROM orders)
       SELECT o_orderkey, floor((p * CAST(CASE platform WHEN 'ebay' THEN 0.18 WHEN 'vinted' THEN 0.05 WHEN 'cardmarket' THEN 0.08 ELSE 0.13 END AS DOUBLE) + CASE platform WHEN 'ebay' THEN 0.3 ELSE 0 END) * 100 + 0.5) / 100 AS fee FROM o""",
)
def _(spark, d):
    k = F.col("o_custkey") % 5
    platform = F.when(k == 0, "ebay").when(k == 1, "vinted").when(k == 2, "cardmarket").when(k == 3, "leboncoin").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", js_round(scores.settlement_fee(F.col("o_totalprice"), platform), 2).alias("fee"))


@query(
    "dm_29_state_history",
    "SELECT user_id, event_id, event_type AS state FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(spark, d):
    return seq.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "state")


@query(
    "dm_31_price_lookup",
    f"""WITH g AS (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last_seen, list_slice(list(l_orderkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC), 1, 5) AS latest FROM lineitem GROUP BY 1)
        SELECT p_partkey, coalesce(n, 0) AS n, last_seen < TIMESTAMP '{AS_OF}' - INTERVAL 330 DAY AS stale, CASE WHEN n >= 3 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence, latest FROM part LEFT JOIN g ON p_partkey = l_partkey""",
)
def _(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    last = seq.keep_last(table(spark, d, "lineitem"), "l_partkey", order, 5)
    latest = last.groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order)), asc=False), lambda s: s["l_orderkey"]).alias("latest"))
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max(when_ts("l_shipdate")).alias("last_seen")).join(latest, "l_partkey")
    rows = table(spark, d, "part").select("p_partkey").join(g, F.col("p_partkey") == F.col("l_partkey"), "left")
    stale = F.col("last_seen") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 330 DAYS")
    return rows.select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), stale.alias("stale"), scores.reliability(F.col("n")).alias("confidence"), "latest")


def _titles(spark, d) -> DataFrame:
    """Listing titles that make the patterns of signatures fire."""
    run = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" /"), F.col("p_size").cast("string"))).otherwise(F.lit(""))
    kind = F.when(F.col("p_partkey") % 11 == 0, " psa 10").when(F.col("p_partkey") % 7 == 0, " signed auto").when(F.col("p_partkey") % 13 == 0, " lot x3").otherwise("")
    title = F.concat("p_name", F.lit(" "), F.concat(F.lit("20"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0")), run, kind, F.lit(" #"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", "p_retailprice", title.alias("title"))


_TITLE = """p_name || ' ' || '20' || lpad(CAST(p_size % 25 AS VARCHAR), 2, '0') || CASE WHEN p_size % 3 = 0 THEN ' /' || p_size ELSE '' END
       || CASE WHEN p_partkey % 11 = 0 THEN ' psa 10' WHEN p_partkey % 7 = 0 THEN ' signed auto' WHEN p_partkey % 13 = 0 THEN ' lot x3' ELSE '' END || ' #' || p_partkey"""


@query(
    "dm_01_signature",
    f"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part)
        SELECT p_partkey, regexp_extract(title, ' (20[0-9]{{2}})\\b', 1) AS year, nullif(regexp_extract(title, ' /([0-9]+)', 1), '') AS print_run, regexp_matches(title, 'signed|auto') AS autograph, regexp_matches(title, 'psa') AS graded, regexp_matches(title, 'lot') AS is_lot,
        CASE WHEN regexp_matches(title, ' /[0-9]') THEN 'numbered' WHEN regexp_matches(title, 'signed') THEN 'signed' WHEN regexp_matches(title, 'psa') THEN 'graded'
        WHEN regexp_matches(lower(title), '\\b(refractor|sapphire|raywave|wave|aqua|gold|silver|pink|purple|green|blue|orange|red|black|white|sepia|checker|flag|zaffiro|viola|violet|fuchsia|shimmer|speckle|base|holo|logofractor|toppsfractor|superfractor|stadium|lazer)\\b') THEN 'variant' ELSE 'base' END AS card_category FROM t""",
)
def _(spark, d):
    return signature.with_signature(_titles(spark, d), "title").select("p_partkey", *[F.col(f"sig.{x}").alias(x) for x in ("year", "print_run", "autograph", "graded", "is_lot", "card_category")])
