"""A table that is kept by key in buckets of files, so that a change rewrites only the buckets that it touches.

Buckets are Hive partitions by a hash of the key; a change reads the touched ones, and
Spark's dynamic partition overwrite puts the new ones in their place when all of them are
written. The result depends on old rows and change only and a key is written once, so a
change that is made twice, because it was cut off or by mistake, changes nothing more.

Defined cases: rows without key are not kept; of several rows of a key in one change
that with the highest ``order`` counts; a bucket that loses its last row keeps a file
with a marker, which readers don't see; an empty change does nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Store:
    path: str
    key: str
    schema: str
    buckets: int = 256

    def _of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _raw(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(self.path)

    def create(self, rows: DataFrame) -> "Store":
        """Writes all buckets, each by one task."""
        known = rows.where(F.col(self.key).isNotNull()).withColumn(_BUCKET, self._of(F.col(self.key)))
        known.repartition(_BUCKET).write.partitionBy(_BUCKET).mode("overwrite").parquet(self.path)
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return self._raw(spark).where(F.col(self.key).isNotNull()).drop(_BUCKET)

    def _change(self, keys: DataFrame, changed) -> int:
        """Rewrites the buckets of ``keys`` with ``changed(old rows)``; how many there are."""
        spark = keys.sparkSession
        touched = [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self._of(F.col(self.key))).distinct().collect()]  # at most all buckets
        if not touched:
            return 0
        old = self._raw(spark).where(F.col(_BUCKET).isin(touched))
        new = changed(old.where(F.col(self.key).isNotNull()).drop(_BUCKET)).withColumn(_BUCKET, self._of(F.col(self.key)))
        marks = spark.createDataFrame([(b,) for b in touched], f"{_BUCKET} int")
        rows = new.unionByName(marks, allowMissingColumns=True).repartition(_BUCKET)
        rows.write.partitionBy(_BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
        return len(touched)

    def upsert(self, rows: DataFrame, order: str, keep: Column | None = None) -> int:
        """``rows`` take the place of those of their keys, unless ``keep`` holds for the old one (its columns are ``old.*``)."""
        last = Window.partitionBy(self.key).orderBy(F.col(order).desc(), F.xxhash64(F.struct(*rows.columns)))
        once = rows.where(F.col(self.key).isNotNull()).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")

        def changed(old: DataFrame) -> DataFrame:
            if keep is None:
                return old.join(once.select(self.key), self.key, "left_anti").unionByName(once)
            both = old.select(self.key, F.struct(*old.columns).alias("old")).join(once.select(self.key, F.struct(*old.columns).alias("new")), self.key, "full")
            return both.select(F.when(F.col("new").isNull() | F.coalesce(keep, F.lit(False)), F.col("old")).otherwise(F.col("new")).alias("_r")).select("_r.*")

        return self._change(once, changed)

    def patch(self, keys: DataFrame, values: dict[str, Column]) -> int:
        """Sets columns of the rows of ``keys``."""
        own = keys.select(self.key).distinct()

        def changed(old: DataFrame) -> DataFrame:
            hit = old.join(own.withColumn("_hit", F.lit(True)), self.key, "left")
            return hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*old.columns)

        return self._change(own, changed)

    def delete(self, keys: DataFrame) -> int:
        own = keys.select(self.key).distinct()
        return self._change(own, lambda old: old.join(own, self.key, "left_anti"))
