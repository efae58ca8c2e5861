"""The flagship: what each product's sales say about buying it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import js_round, mean_cents, median_mid, median_upper, variation
from ..operators import scores
from ..operators import sequences as seq
from .base import c, query, r2, table


@query(
    "flagship",
    f"""WITH i AS (SELECT *, (epoch_us(l_shipdate) - lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber)) / 86400000000.0 AS days FROM lineitem),
        g AS (SELECT l_partkey, count(*) AS n, median(l_extendedprice) AS ma, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median_upper, CAST(sum({c('l_extendedprice')}) AS DOUBLE) / count(*) / 100 AS mean,
          CASE WHEN count(*) >= 2 THEN stddev_pop(l_extendedprice) / nullif(avg(l_extendedprice), 0) END AS cv, floor(sum(days) / nullif(count(days), 0) * 100 + 0.5) / 100 AS mean_days FROM i GROUP BY 1 HAVING count(*) >= 3)
        SELECT p_partkey, n, {r2('ma')} AS median_mid, median_upper, floor(cv * 10000 + 0.5) / 10000 AS cv, mean_days, {r2('mean * 0.84 - 4.5 - (p_retailprice + 3.5)')} AS profit,
        CASE WHEN n <= 2 THEN 15 WHEN n <= 5 THEN 30 WHEN n <= 10 THEN 60 WHEN n <= 20 THEN 80 ELSE 100 END AS volume, CASE WHEN mean_days < 1 THEN 100 WHEN mean_days < 3 THEN 80 WHEN mean_days < 7 THEN 60 WHEN mean_days < 14 THEN 40 ELSE 20 END AS speed
        FROM part JOIN g ON p_partkey = l_partkey""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with three sales or more: middles, variation, interval, profit and pace."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    x = F.col("l_extendedprice")
    # one exchange by product serves the window and the aggregate
    days = seq.days_before(li, "l_partkey", "l_shipdate", ["l_orderkey", "l_linenumber"])
    mean_days = js_round(F.sum("days") / F.count("days"), 2)
    sold = days.groupBy("l_partkey").agg(F.count(x).alias("n"), js_round(median_mid(x), 2).alias("median_mid"), median_upper("l_extendedprice").alias("median_upper"), mean_cents(x).alias("mean"), js_round(variation(x), 4).alias("cv"), mean_days.alias("mean_days")).where("n >= 3")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").join(sold, F.col("p_partkey") == F.col("l_partkey"))
    profit = scores.net_sale(F.col("mean")) - scores.total_cost(F.col("p_retailprice"), F.col("p_retailprice"))
    return rows.select("p_partkey", "n", "median_mid", "median_upper", "cv", "mean_days", js_round(profit, 2).alias("profit"), scores.volume_step(F.col("n")).alias("volume"), scores.speed_step(F.col("n"), F.col("mean_days")).alias("speed"))
