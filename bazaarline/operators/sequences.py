"""Operators on ordered rows of a key: intervals, trends, streaks, keep-last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import js_round, ladder


def days_before(df: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Adds ``days`` since the row of the key before; null for its first."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts, *order))
    return df.withColumn("days", (F.unix_micros(F.col(ts).cast("timestamp")) - before) / 86_400_000_000.0)


def intervals(df: DataFrame, key: str, ts: str, order: list[str], positive_only: bool = False) -> DataFrame:
    """Days between consecutive rows of a key; optionally only those above zero."""
    out = days_before(df, key, ts, order).where(F.col("days").isNotNull())
    return out.where("days > 0") if positive_only else out.where("days >= 0")


def on_every_day(df: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day): each key on each day of any row. The days are one row, of at most 36,525 in a century."""
    days = df.agg(F.collect_set(day).alias("_days"))
    return df.select(key).distinct().crossJoin(F.broadcast(days)).select(key, F.explode("_days").alias(day))


def ends(df: DataFrame, key: str, value: str, order: list[str], last: int = 6, first: int = 3) -> DataFrame:
    """(key, n, last, first): how many rows a key has, and its last and first few values in order.

    Spark prunes to the last and first rows before the shuffle.
    """
    rows = df.select(key, *order, F.col(value).alias("_x"))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def some(k: int, out: str, downwards: bool) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*[F.col(c).desc() if downwards else F.col(c).asc() for c in order])
        few = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
        return few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_x"))), lambda s: s["_x"]).alias(out))

    out = n.join(some(last, "last", True), key)
    return out.join(some(first, "first", False), key) if first else out


def half_means(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, n, old, new): means of the earlier and the later half of each key's values, the later one the longer."""
    w = Window.partitionBy(key)
    placed = df.select(key, F.col(value).alias("_x"), F.row_number().over(w.orderBy(*order)).alias("_k"), F.count(F.lit(1)).over(w).alias("_n"))
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    return placed.groupBy(key).agg(F.first("_n").alias("n"), F.avg(F.when(early, F.col("_x"))).alias("old"), F.avg(F.when(~early, F.col("_x"))).alias("new"))


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def trend(xs: Column, n: Column, least: int, band: float, previous: Column | None = None) -> tuple[Column, Column]:
    """(label, change) of the last six of ``n`` values at most: the mean of the last three against ``previous``, else those before."""
    last = F.slice(xs, -3, 3)
    head = previous if previous is not None else F.slice(xs, F.lit(1), F.size(xs) - 3)
    change = F.when(F.size(head) > 0, (mean_of(last) - mean_of(head)) / F.nullif(mean_of(head), F.lit(0.0)))
    label = F.when(n < least, "unknown").when(change > band, "rising").when(change < -band, "falling").otherwise("stable")
    return label, F.when(n >= least, change)


def zero_streak(df: DataFrame, key: str, order: list[str], zero: Column) -> DataFrame:
    """(key, streak): how many of the last rows of a key in a row meet ``zero``."""
    latest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    marked = df.withColumn("_zero", zero).withColumn("_k", F.row_number().over(latest))
    return marked.groupBy(key).agg(F.coalesce(F.min(F.when(~F.col("_zero"), F.col("_k"))) - 1, F.count(F.lit(1))).cast("long").alias("streak"))


def running_streak(df: DataFrame, key: str, order: list[str], failed: Column, ok: Column) -> DataFrame:
    """Adds ``streak``: failures since the last success of the key; rows that are neither are passed over."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_island", F.sum(ok.cast("int")).over(w)).withColumn("_failed", failed.cast("int"))
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum("_failed").over(inside)).drop("_island", "_failed")


def keep_last(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key; Spark prunes to ``n`` before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def changes(df: DataFrame, key: str, order: list[str], state: Column) -> DataFrame:
    """Rows whose state differs from the one before within the key; the first counts."""
    df = df.withColumn("_state", state)
    before = F.lag("_state").over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_was", before).where(~F.col("_state").eqNullSafe(F.col("_was"))).drop("_was").withColumnRenamed("_state", "state")


def volatility_label(cv: Column) -> Column:
    return ladder(cv, [(">", 0.30, "high"), (">", 0.15, "medium")], "low")


def rounded_percent(x: Column) -> Column:
    return js_round(x * 100, 0).cast("long")
