"""Work tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet there. The folder is the one named by
``spark.checkpoint.dir``; only where that is unset (single-machine tests) a
temporary folder is made and remembered for the session. A result reads work
tables until it is written itself; :func:`work_tables` tells which ones, so that
they can be dropped then.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster, as a URI Spark can write to."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="bazaarline-")
    return _OWN[app]


@contextmanager
def work_tables() -> Iterator[list[str]]:
    """Collects the paths of work tables made within, for :func:`drop` once what reads them is written."""
    made: list[str] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield made
    finally:
        _MADE.reset(token)


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _MADE.get():
        made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a work table and read it back: computed once, lineage cut."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`keep`; also returns the path, for :func:`drop`."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def finished(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """:func:`keep`, after which the work tables ``made`` for ``df`` are dropped."""
    old = list(made)
    out = keep(df, name)
    for path in old:
        drop(df.sparkSession, path)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
