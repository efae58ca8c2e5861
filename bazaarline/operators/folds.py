"""Folds whose result depends on the order of rows, in memory that doesn't grow with them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incremental_mean(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n, mean): the mean of a key's values as one that is carried on by each row in ``order`` and rounded to cents each time.

    Rounding at each step keeps a key's rows from being added up apart. So a key's rows
    come sorted, some at a time, and only its count and mean are kept; Spark sorts
    and spills. Rows without a value are left out; a null key is a key like others.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).cast("double").alias("_x"))
    placed = rows.repartition("_key").sortWithinPartitions("_key", *[f"_o{k}" for k in range(len(order))]).select("_key", "_x")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, key, n, mean, begun = math.floor, None, 0, 0.0, False
        for batch in batches:
            done: list[tuple] = []
            for k, x in zip(batch.column("_key").to_pylist(), batch.column("_x").to_pylist(), strict=True):
                if not begun or k != key:
                    if begun:
                        done.append((key, n, mean))
                    key, n, mean, begun = k, 1, x, True
                else:
                    mean = floor((mean * n + x) / (n + 1) * 100 + 0.5) / 100
                    n += 1
            yield _batch(done, batch.schema.field("_key").type)
            kind = batch.schema.field("_key").type
        if begun:
            yield _batch([(key, n, mean)], kind)

    return placed.mapInArrow(folded, f"_key {df.schema[key].dataType.simpleString()}, n long, mean double").withColumnRenamed("_key", key)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, ns, means = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(ns, pa.int64()), pa.array(means, pa.float64())], ["_key", "n", "mean"])
