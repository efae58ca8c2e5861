"""Grouped price statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import at_quantile, js_round, mean_cents, median_mid, median_upper, or_else, share, variation


def price_summary(df: DataFrame, key: str, price: str) -> DataFrame:
    """min, max and mean of positive prices by key; 0 where there are none."""
    positive = F.when(F.col(price) > 0, F.col(price))
    zero = F.lit(0.0)
    return df.groupBy(key).agg(
        F.coalesce(F.min(positive), zero).alias("min_price"),
        F.coalesce(F.max(positive), zero).alias("max_price"),
        F.coalesce(js_round(mean_cents(positive), 2), zero).alias("avg_price"),
    )


def price_details(df: DataFrame, key: str, price: str, fallback: str) -> DataFrame:
    """count, min and max of ``price || fallback`` above zero."""
    known = df.withColumn("_p", or_else(F.col(price), F.col(fallback))).where("_p > 0")
    return known.groupBy(key).agg(F.count("_p").alias("n"), F.min("_p").alias("min_price"), F.max("_p").alias("max_price"))


def quartiles(df: DataFrame, key: str, price: str, least: int = 5) -> DataFrame:
    """Quartiles by position, mean, both medians and range of groups with at least so many rows."""
    x = F.col(price)
    return (
        df.groupBy(key)
        .agg(F.count(x).alias("n"), at_quantile(price, 0.25).alias("q1"), at_quantile(price, 0.75).alias("q3"), js_round(mean_cents(x), 2).alias("mean"), js_round(median_mid(x), 2).alias("median"), F.min(x).alias("low"), F.max(x).alias("high"))
        .where(F.col("n") >= least)
    )


def conditional_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """One pass: how many rows of each group meet each condition."""
    return df.groupBy(*keys).agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in flags.items()])


def accept_rates(df: DataFrame, key: str, accepted: Column, rejected: Column) -> DataFrame:
    """Accepts, rejects and rate by key, with the flags of a problematic and of a to-be-disabled category."""
    counts = conditional_counts(df, [key], {"accepted": accepted, "rejected": rejected})
    n = F.col("accepted") + F.col("rejected")
    rate = F.coalesce(share(F.col("accepted"), n), F.lit(0.0))
    return counts.withColumn("rate", js_round(rate * 100, 2)).withColumn("problematic", (n >= 5) & (rate <= 0.10)).withColumn("disable", (n >= 20) & (rate <= 0.05))


def frequencies(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Counts with percent of the whole; ``top`` keeps the most frequent, ties by key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    out = out.select(key, "n", js_round(F.col("n") * 100.0 / F.col("_all"), 2).alias("percent"))
    return out.orderBy(F.col("n").desc(), key).limit(top) if top else out


def variation_by(df: DataFrame, key: str, price: str) -> DataFrame:
    return df.groupBy(key).agg(js_round(variation(F.col(price)), 4).alias("cv"))


def medians_by(df: DataFrame, key: str, price: str) -> DataFrame:
    """All definitions of the middle side by side; the conservative price is the lesser of median and mean."""
    x = F.col(price)
    return df.groupBy(key).agg(
        js_round(median_mid(x), 2).alias("median_mid"), median_upper(price).alias("median_upper"), js_round(F.least(median_mid(x), mean_cents(x)), 2).alias("conservative")
    )
