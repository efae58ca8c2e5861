"""Token counts through a cache keyed by content and tokenizer digests.

Each text is known by the SHA-256 of its normalised content (null became empty;
anything else could change the count), each tokenizer by the SHA-256 of its
file. Counts that the cache has are looked up; of the others each distinct text
is encoded once and appended to the cache, from which all documents then read.

Missed texts that one document alone has are encoded where they lie; those of
several documents are shuffled, pre-aggregated to one per map task. Where the cache
has some of the texts, what a bitmap of the misses lets through is joined to them
before it is encoded, so no cached text is encoded again.

Defined cases: null text counts as empty, 0 tokens; repeated rows each get a row
out; an empty table gives no rows and appends nothing; columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .membership import MOST, bitmap, filtered, with_membership
from .storage import keep

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function from a text to its number of tokens; one per Python worker."""
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encode(texts: DataFrame, path: str) -> DataFrame:
    """(_digest, _text) to (_digest, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = _counter(path)
        for batch in batches:
            counts = [n_tokens(text.as_py()) for text in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), pa.array(counts, pa.int64())], ["_digest", "n_tokens"])

    return texts.select("_digest", "_text").mapInArrow(count, "_digest binary, n_tokens long")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; empty if nothing was appended yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens. Appends what it had to encode to the cache."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    rows = keep(own.select("_id", "_digest", F.octet_length("_text").cast("long").alias("n_bytes")), "count-rows")

    def cached() -> DataFrame:
        # two runs at once may have appended the same text twice
        return read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("_digest")).agg(F.min("n_tokens").alias("n_tokens"))

    wanted = keep(rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")), "count-digests")
    missed = keep(wanted.join(cached(), "_digest", "left_anti").withColumn("_key", F.xxhash64("_digest")), "count-missed")
    texts = own.withColumn("_key", F.xxhash64("_digest"))
    if missed.count() < wanted.count():
        texts = filtered(texts, missed, "_key", most).join(missed.select("_digest"), "_digest", "left_semi")
    texts = with_membership(texts, bitmap(keep(missed.where("_n > 1"), "count-many"), "_key", most), "_key", "_many")
    alone = _encode(texts.where("not _many"), tokenizer_path)
    new = alone.unionByName(_encode(texts.where("_many").groupBy("_digest").agg(F.first("_text").alias("_text")), tokenizer_path))
    new.select(F.lit(version).alias("tokenizer"), F.col("_digest").alias("digest"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = keep(wanted.select("_digest").join(cached(), "_digest"), "count-known")
    return rows.join(counts, "_digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
