"""Event streams: windows, TTL state, streak counters.

Each function takes a DataFrame that may be a stream or a batch where Spark
allows both; the counters keep their state by key with a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def sliding_counts(events: DataFrame, ts: str, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen_only(events: DataFrame, ts: str, keys: list[str], ttl: str = "6 hours") -> DataFrame:
    """Each key once within its TTL; state is dropped as the watermark passes."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def error_streaks(events: DataFrame, key: str = "user_id", threshold: int = 3) -> DataFrame:
    """(key, event_id, streak) of each alert: the event at which a key's consecutive errors reach ``threshold``."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            error = pdf["event_type"] == "error"
            since = (~error).cumsum()  # streaks are told apart by the other events before them
            streaks = error.groupby(since).cumsum() + since.eq(0) * streak
            alerts = pdf.loc[error & (streaks == threshold), ["event_id"]]
            streak = int(streaks.iloc[-1]) if len(pdf) and error.iloc[-1] else 0 if len(pdf) else streak
            yield alerts.assign(**{key: name[0], "streak": threshold})[[key, "event_id", "streak"]]
        state.update((streak,))
        state.setTimeoutDuration(24 * 3600 * 1000)

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, event_id long, streak long", "streak long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def round_robin(batch_id: int, names: list[str]) -> str:
    """The one of ``names`` whose turn it is; for use in ``foreachBatch``."""
    return names[batch_id % len(names)]


def in_turn(batch: Column, names: Column) -> Column:
    """:func:`round_robin` by columns: the one of an array whose turn it is; null for an empty array or a null batch."""
    return F.try_element_at(names, (F.pmod(batch, F.nullif(F.size(names), F.lit(0))) + 1).cast("int"))
