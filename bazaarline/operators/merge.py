"""Set operators, upserts and merges with history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Current rows, and previous ones of keys that aren't current."""
    return current.unionByName(previous.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_history(new: DataFrame, old: DataFrame, key: str, first_seen: str, last_seen: str, keep_old: Column) -> DataFrame:
    """New rows win but keep the first sighting; old ones that aren't new stay, marked stale, while ``keep_old`` holds."""
    seen = old.select(key, F.col(first_seen).alias("_first"))
    fresh = new.join(seen, key, "left").withColumn(first_seen, F.least(F.col(first_seen), F.coalesce("_first", first_seen))).drop("_first").withColumn("stale", F.lit(False))
    kept = old.where(keep_old).join(new.select(key), key, "left_anti").withColumn("stale", F.lit(True))
    return fresh.unionByName(kept)


def upsert(target: DataFrame, source: DataFrame, key: str, changed: dict[str, Column]) -> DataFrame:
    """Full outer merge: each column of ``changed`` is an expression over t_* (target) and s_* (source) columns."""
    t = target.select(key, *[F.col(x).alias(f"t_{x}") for x in target.columns if x != key])
    s = source.select(key, *[F.col(x).alias(f"s_{x}") for x in source.columns if x != key])
    return t.join(s, key, "full").select(key, *[expr.alias(name) for name, expr in changed.items()])


def expired(status: Column, confidence: Column, age_days: Column, manual: Column) -> Column:
    """New status: active ages out after seven days, candidates after three; manual overrides never do."""
    return (
        F.when(manual, status)
        .when((status == "active") & (age_days > 7), F.lit("expired"))
        .when((status == "candidate") & (age_days > 3), F.lit("expired"))
        .otherwise(status)
    )


def prune_protected(df: DataFrame, recent: Column, least: int) -> DataFrame:
    """Recent rows only, unless fewer than ``least`` would survive; then all."""
    survivors = df.agg(F.count_if(recent).alias("_survivors"))
    return df.crossJoin(F.broadcast(survivors)).where(recent | (F.col("_survivors") < least)).drop("_survivors")  # one row


def without_listed(df: DataFrame, ids: DataFrame, id_col: str, titles: DataFrame, title_col: str) -> DataFrame:
    """Rows on neither list: two anti joins, each on one key."""
    return df.join(ids.select(id_col), id_col, "left_anti").join(titles.select(title_col), title_col, "left_anti")
