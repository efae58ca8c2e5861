"""Sorting, limits, deduplication and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key


def first_per(df: DataFrame, keys: list[str | Column], order: list[Column | str]) -> DataFrame:
    """One row of each key: the first in ``order``, which must be total for a fixed result."""
    names = [f"_key{k}" for k in range(len(keys))]
    df = df.withColumns({n: (F.col(k) if isinstance(k, str) else k) for n, k in zip(names, keys, strict=True)})
    w = Window.partitionBy(*names).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", *names)


def top_per(df: DataFrame, key: str, order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def by_url_then_title(df: DataFrame, url: str, title: str, price: str, seq: str, length: int = 80, least: int = 10) -> DataFrame:
    """First row of each URL; of equal long titles the cheapest, then the earliest. Short titles are never merged."""
    once = first_per(df, [url], [seq])
    once = once.withColumn("_title", title_key(F.col(title), length))
    short = once.where(F.length("_title") < least)
    return short.unionByName(first_per(once.where(F.length("_title") >= least), ["_title"], [price, seq])).drop("_title")


def last_wins(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Last row of each first non-empty key."""
    key = F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])
    return first_per(df, [key], [F.col(s).desc() for s in seq])


def by_rank(df: DataFrame, key: str, rank: Column, latest: str, tie: str) -> DataFrame:
    """One row of each key, by rank of its status, then latest; rows without key all stay."""
    known = df.where(F.col(key).isNotNull()).withColumn("_rank", rank)
    best = first_per(known, [key], ["_rank", F.col(latest).desc(), tie]).drop("_rank")
    return best.unionByName(df.where(F.col(key).isNull()))


def shortlist(df: DataFrame, key: str, score: str, recent: list[Column], floor: float, slack: float, n: int) -> DataFrame:
    """Per key the rows within ``slack`` of the best score and at least ``floor``, the most recent ``n`` of them."""
    best = F.max(score).over(Window.partitionBy(key))
    kept = df.withColumn("_floor", F.greatest(F.lit(floor), best - slack)).where(F.col(score) >= F.col("_floor")).drop("_floor")
    return top_per(kept, key, recent, n)


def capped_pages(df: DataFrame, query: str, search: str, order: list[str], per_query: int, per_search: int) -> DataFrame:
    """At most so many rows of each query, then of each search, in order of arrival."""
    return top_per(top_per(df, query, order, per_query), search, [query, *order], per_search)


def pools(df: DataFrame, key: str, specificity: str, price: str, tie: str, n: int) -> DataFrame:
    """The three pools of candidates with their place: most specific, cheapest, densest in value."""
    density = F.col(specificity) / F.greatest(F.col(price), F.lit(1.0))
    orders = {"specific": [F.col(specificity).desc(), F.col(price), F.col(tie)], "cheap": [F.col(price), F.col(tie)], "dense": [density.desc(), F.col(price), F.col(tie)]}
    out = None
    for k, (name, order) in enumerate(orders.items()):
        pool = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n).withColumn("pool", F.lit(name)).withColumn("pool_no", F.lit(k))
        out = pool if out is None else out.unionByName(pool)
    return out


def interleave(df: DataFrame, key: str, place: str, list_no: str, url: str, n: int) -> DataFrame:
    """Round-robin over the lists of a key: one from each in turn, first occurrence of a URL only, at most ``n``."""
    once = first_per(df, [key, url], [place, list_no])
    turn = F.row_number().over(Window.partitionBy(key).orderBy(place, list_no))
    return once.withColumn("turn", turn).where(F.col("turn") <= n)
