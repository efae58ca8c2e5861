"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import scratch as scratch  # for the plans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The clock of all queries on sales and orders, and of those on events.
AS_OF, EVENTS_AS_OF = "2001-12-31 00:00:00", "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under ``name``, with DuckDB SQL if it has any."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def when_ts(name: str) -> Column:
    """A zone-less driver timestamp as an instant; sessions run in UTC."""
    return F.col(name).cast("timestamp")


def clock(at: str) -> Column:
    return F.lit(at).cast("timestamp")


def r2(x: str) -> str:
    """SQL of ``js_round(x, 2)``."""
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def c(x: str) -> str:
    """SQL of ``cents(x)``."""
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"
