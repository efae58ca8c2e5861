"""Caches and budgets as keyed state of a stream: seen items, prices and daily counters.

Rows of a key are held until the watermark has passed them, so they are
taken in order of time even where they come late, and the same rows come out as if the
whole stream had been sorted first. Timers of event time do the rest: they admit
what waits, drop entries at the end of their time to live, and reset counters at midnight.
Rows that are later than the watermark allows are dropped. Everything is in the
state store, so a restart from the checkpoint goes on where the stream stopped. The
state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).

Null event times never pass the watermark and are dropped; rows with equal time are
taken in order of ``event_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_HOUR = 3_600_000
_DAY = 24 * _HOUR
_WAITING = "at long, event_id long, value string"


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then gives them to :meth:`take` in order. ``columns`` are those of the result."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Makes further state."""

    def wanted(self, rows: list[tuple]) -> list[tuple]:
        """Those of the waiting rows, in order, that can still be taken."""
        return rows

    def take(self, key: tuple, rows: list[tuple], now: int) -> Iterator[Row]:
        raise NotImplementedError

    def _pass(self, key: tuple, rows: list[tuple], now: int) -> Iterator[Row]:
        ready = [r for r in rows if r[0] < now]
        later = self.wanted(rows[len(ready) :])
        if ready:
            yield from self.take(key, ready, now)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] + 1)
        else:
            self.waiting.clear()

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        new = [(r["at"], r["event_id"], r["value"]) for r in rows if r["at"] >= now]
        yield from self._pass(key, sorted([*self._held(), *new], key=lambda r: r[:2]), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._pass(key, sorted(self._held(), key=lambda r: r[:2]), timerValues.getCurrentWatermarkInMs())
        yield from self.expired(key, timerValues.getCurrentWatermarkInMs())

    def expired(self, key: tuple, now: int) -> Iterator[Row]:
        """Drops what has outlived its time."""
        return iter(())

    def close(self) -> None:
        pass


class SeenCache(_InOrder):
    """Admits a row of a key that was not admitted within ``ttl`` before; the entry goes at the end of its time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def take(self, key, rows, now):
        last = self.seen.get()[0] if self.seen.exists() else None
        for at, event_id, value in rows:
            if last is None or at - last >= self.ttl:
                last = at
                yield Row(*self.columns)(*key, event_id, value)
        if last is not None:
            self.seen.update((last,))
            self.handle.registerTimer(last + self.ttl + 1)

    def expired(self, key, now):
        if self.seen.exists() and self.seen.get()[0] + self.ttl < now:
            self.seen.clear()
        return iter(())


class PriceCache(_InOrder):
    """Says of each lookup whether its entry was there and younger than ``ttl``; a miss puts it there. Where that would be the entry after ``most``, all others go first."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "value string", "at long")

    def take(self, key, rows, now):
        held = {k[0]: v[0] for k, v in self.entries.iterator()} if self.entries.exists() else {}
        for at, event_id, value in rows:
            held = {k: v for k, v in held.items() if at - v < self.ttl}
            hit = value in held
            if not hit:
                if len(held) >= self.most:
                    held = {}
                held[value] = at
            yield Row(*self.columns)(*key, event_id, hit)
        self._keep(held)

    def _keep(self, held: dict) -> None:
        self.entries.clear()
        for k, v in held.items():
            self.entries.updateValue((k,), (v,))
        if held:
            self.handle.registerTimer(min(held.values()) + self.ttl + 1)

    def expired(self, key, now):
        if self.entries.exists():
            held = {k[0]: v[0] for k, v in self.entries.iterator()}
            live = {k: v for k, v in held.items() if v + self.ttl >= now}
            if len(live) < len(held):
                self._keep(live)
        return iter(())


class DailyBudget(_InOrder):
    """Admits the first ``budget`` rows of each day (UTC); the counter is reset at the change of date."""

    def __init__(self, budget: int):
        self.budget = budget

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "day long, n long")

    def wanted(self, rows):
        """Of a day no more than the budget can be taken."""
        out, day, n = [], None, 0
        for r in rows:
            day, n = (day, n + 1) if r[0] // _DAY == day else (r[0] // _DAY, 1)
            if n <= self.budget:
                out.append(r)
        return out

    def take(self, key, rows, now):
        day, n = self.spent.get() if self.spent.exists() else (None, 0)
        for at, event_id, value in rows:
            day, n = (day, n) if at // _DAY == day else (at // _DAY, 0)
            if n < self.budget:
                n += 1
                yield Row(*self.columns)(*key, event_id, value)
        self.spent.update((day, n))
        self.handle.registerTimer((day + 1) * _DAY + 1)

    def expired(self, key, now):
        if self.spent.exists() and (self.spent.get()[0] + 1) * _DAY < now:
            self.spent.clear()
        return iter(())


def _rows(events: DataFrame, ts: str, keys: list[str], id_col: str, value: Column) -> DataFrame:
    known = events.where(F.col(ts).isNotNull())
    return known.select(*keys, F.col(ts).alias("_ts"), F.unix_millis(ts).alias("at"), F.col(id_col).cast("long").alias("event_id"), value.cast("string").alias("value"))


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _stateful(rows: DataFrame, keys: list[str], late: str, processor: _InOrder, out: str) -> DataFrame:
    processor.columns = [*keys, "event_id", out.split()[0]]
    return rows.withWatermark("_ts", late).groupBy(*keys).transformWithState(processor, f"{_schema(rows, keys)}, event_id long, {out}", "Append", "EventTime")


def seen_once(events: DataFrame, ts: str, keys: list[str], ttl_hours: float = 6, late: str = "10 minutes", id_col: str = "event_id") -> DataFrame:
    """(keys, event_id, at): events whose keys were not let through within ``ttl_hours`` before; ``at`` is their time in milliseconds."""
    rows = _rows(events, ts, keys, id_col, F.unix_millis(ts))
    return _stateful(rows, keys, late, SeenCache(int(ttl_hours * _HOUR)), "at string").withColumn("at", F.col("at").cast("long"))


def cached_prices(events: DataFrame, ts: str, cache: str, title: str, ttl_hours: float = 2, most: int = 500, late: str = "10 minutes", id_col: str = "event_id") -> DataFrame:
    """(cache, event_id, hit): whether a lookup of ``title`` finds its price in the cache named by ``cache``."""
    return _stateful(_rows(events, ts, [cache], id_col, F.col(title)), [cache], late, PriceCache(int(ttl_hours * _HOUR), most), "hit boolean")


def within_budget(events: DataFrame, ts: str, key: str, budget: int = 50, late: str = "10 minutes", id_col: str = "event_id") -> DataFrame:
    """(key, event_id, at): the first ``budget`` events of a key and day.

    Tasks first leave out what has ``budget`` earlier events beside it, so a key that most
    events have moves few of them, and its state holds no more than budgets of the days still open.
    """
    rows = _rows(events, ts, [key], id_col, F.unix_millis(ts))

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            day = (f["at"] // _DAY).rename("_day")
            yield f.sort_values(["at", "event_id"]).groupby([key, day], dropna=False).head(budget)

    pruned = rows.mapInPandas(firsts, rows.schema)
    return _stateful(pruned, [key], late, DailyBudget(budget), "at string").withColumn("at", F.col("at").cast("long"))
