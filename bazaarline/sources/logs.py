"""JSON-lines logs and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "ts timestamp, `from` string, `to` string, type string, payload string"


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str = MESSAGE) -> DataFrame:
    """Lines that aren't JSON of the schema are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replaces the snapshot at ``path``, as JSON lines for :func:`read_log`."""
    df.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """The rows of whole-document snapshots: each file below ``path`` an array of rows, one row, or an object that holds rows under ``items``.

    A missing path gives ``default``, no rows if there is none.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema) if default is None else default
    rows = spark.read.schema(f"{schema}, items array<struct<{schema}>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    plain = rows.where("items IS NULL").drop("items")
    return plain.unionByName(rows.where("items IS NOT NULL").select(F.inline("items")))


def live(df: DataFrame, ts: str, as_of: Column, ttl: str = "24 HOURS") -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {ttl}"))


def report_lines(df: DataFrame, parts: list[Column], order: list[str | Column]) -> DataFrame:
    """One text line per row, in order; the sink decides where they go."""
    return df.orderBy(*order).select(F.concat_ws(" | ", *[p.cast("string") for p in parts]).alias("line"))
