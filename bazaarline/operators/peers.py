"""Cheap rows against the rows of their group that look alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

#: Rows of a block; two blocks of vectors are what a task holds at once. Vectors that rows are dealt by, and rows they are chosen from.
BLOCK, ANCHORS, SAMPLE = 512, 256, 2048


def _units(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _anchors(rows: DataFrame) -> np.ndarray:
    """``ANCHORS`` vectors, each the one farthest from all before it among ``SAMPLE`` rows with the least hashes of their ids.

    They only say which rows lie together; results don't depend on them.
    """
    some = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not some:
        return np.zeros((0, 0))
    units = _units([r["v"] for r in some])
    taken, nearest = [0], units @ units[0]
    while len(taken) < min(ANCHORS, len(units)):
        taken.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[taken[-1]])
    return units[taken]


def _blocks(placed: DataFrame, anchors: np.ndarray) -> DataFrame:
    """(g, cheap, block, n, centre, spread, ids, ps, vs): rows of one side of a group that lie near the same anchor, ``BLOCK`` at most by hash.

    ``spread`` is the widest angle from the centre. A group of a few blocks' size has fewer anchors, one of a block none.
    """

    def near(v: pd.Series, most: pd.Series) -> pd.Series:
        allowed = np.arange(len(anchors))[None, :] < most.to_numpy()[:, None]
        return pd.Series(np.where(allowed, _units(v) @ anchors.T, -2.0).argmax(1) if len(v) else np.zeros(0), dtype="int32")

    cells = placed.withColumn("cell", F.pandas_udf(near, "int")("v", F.ceil(F.col("n") / BLOCK).cast("int")))
    sizes = cells.groupBy("g", "cheap", "cell").agg(F.count(F.lit(1)).alias("m")).withColumnsRenamed({"g": "h", "cheap": "ch", "cell": "ce"})
    same = F.col("g").eqNullSafe(F.col("h")) & (F.col("cheap") == F.col("ch")) & (F.col("cell") == F.col("ce"))
    dealt = cells.join(sizes, same).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)))
    packed = dealt.groupBy("g", "cheap", "cell", "part").agg(F.collect_list(F.struct("id", "p", "v")).alias("rows"))

    def centred(vs: pd.Series) -> pd.DataFrame:
        out = []
        for v in vs:
            u = _units(v)
            c = u.sum(0)
            size = np.linalg.norm(c)
            c = c / size if size > 0 else u[0]
            out.append((c.tolist(), float(np.arccos(np.clip((u @ c).min(), -1, 1)))))
        return pd.DataFrame(out, columns=["centre", "spread"])

    around = F.pandas_udf(centred, "centre array<double>, spread double")
    named = packed.select("g", "cheap", F.xxhash64("g", "cheap", "cell", "part").alias("block"), F.size("rows").alias("n"), F.col("rows.id").alias("ids"), F.col("rows.p").alias("ps"), F.col("rows.v").alias("vs"))
    return named.withColumn("_c", around("vs")).select("*", "_c.*").drop("_c")


def block_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(block, other, n, m): the pairs of a group's cheap blocks and others that can hold vectors alike to ``least``.

    Vectors are as far apart as their blocks' centres less both spreads at least, so blocks farther than the angle
    of ``least`` apart hold none, and no pair is lost.
    """
    a = blocks.where("cheap").select("g", "block", "n", "centre", "spread")
    b = blocks.where("NOT cheap").select(F.col("g").alias("h"), F.col("block").alias("other"), F.col("n").alias("m"), F.col("centre").alias("c2"), F.col("spread").alias("s2"))
    product = F.aggregate(F.zip_with("centre", "c2", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), product)))
    far = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.lit(float(least)))))
    return a.join(b, F.col("g").eqNullSafe(F.col("h"))).where(angle <= F.col("spread") + F.col("s2") + far + 1e-9).select("block", "other", "n", "m")


def placed_rows(df: DataFrame, group: str, id_col: str, price: str, vector: str) -> DataFrame:
    """(g, id, p, v, n, cheap): the rows of groups of four or more, and whether they are of their group's cheapest quarter."""
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(price).cast("double").alias("p"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("p").isNotNull() & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    # a row's place is its price's place among the counted prices, then its id's: no sort of a whole group
    counted = rows.groupBy("g", "p").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    cut = counted.withColumn("before", before).join(sizes, F.col("g").eqNullSafe(F.col("h"))).select("g", "p", "before", F.ceil(F.col("n") / 4).alias("quarter"), "n")
    tie = F.row_number().over(Window.partitionBy("g", "p").orderBy("id"))
    placed = rows.withColumn("tie", tie).alias("r").join(cut.alias("c"), F.col("r.g").eqNullSafe(F.col("c.g")) & (F.col("r.p") == F.col("c.p")))
    return placed.select("r.g", "r.id", "r.p", "r.v", "c.n", (F.col("c.before") + F.col("tie") <= F.col("c.quarter")).alias("cheap"))


def cheap_against_rest(df: DataFrame, group: str, id_col: str, price: str, vector: str, least: float, need: int = 2) -> DataFrame:
    """(id, price, peers, median, mean) of a group's cheapest quarter with at least ``need`` peers among the others.

    The quarter, rounded up, is the query set; groups of fewer than four rows have
    none. Both sides lie in blocks of vectors near each other; pairs of blocks too far
    apart are left out (:func:`block_pairs`), the others are one product of matrices each, so
    the rows are exact. Peers leave it as counts by price. Rows without id, price or
    vector, and vectors of length 0, are left out. The median is the upper one of the
    two in the middle. Ids are unique; rows of one price in one group are ranked by id in
    one sort.
    """
    placed = written(placed_rows(df, group, id_col, price, vector), "peer-rows")
    blocks = written(_blocks(placed, _anchors(placed)), "peer-blocks")
    a = blocks.where("cheap").select("block", "ids", F.col("ps").alias("cheap_ps"), F.col("vs").alias("cheap_vs"))
    b = blocks.where("NOT cheap").select(F.col("block").alias("other"), "ps", "vs")
    id_type = df.schema[id_col].dataType.simpleString()

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                i, j = np.nonzero(_units(r.cheap_vs) @ _units(r.vs).T >= least)
                pairs = pd.DataFrame({"id": np.asarray(r.ids)[i], "own": np.asarray(r.cheap_ps)[i], "p": np.asarray(r.ps)[j]})
                yield pairs.groupby(["id", "own", "p"]).size().reset_index(name="m")

    met = block_pairs(blocks, least).select("block", "other").join(a, "block").join(b, "other").drop("block", "other")
    pairs = met.mapInPandas(compared, f"id {id_type}, own double, p double, m long")
    alike = pairs.groupBy("id", "own", "p").agg(F.sum("m").alias("m"))
    mine = Window.partitionBy("id", "own")
    upto = F.sum("m").over(mine.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = alike.select("id", "own", "p", "m", upto.alias("upto"), F.sum("m").over(mine).alias("peers"))
    out = ranked.groupBy("id", "own", "peers").agg(F.min(F.when(F.col("upto") > F.floor(F.col("peers") / 2), F.col("p"))).alias("median"), (F.sum(F.col("p") * F.col("m")) / F.col("peers")).alias("mean"))
    return out.where(F.col("peers") >= need).select(F.col("id").alias(id_col), F.col("own").alias(price), "peers", "median", "mean")
