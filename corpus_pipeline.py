"""From documents to token ids: the stages of a training-data pipeline.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's documents. Nulls, empty tables, repeated
rows and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarline.llm import bpe_chunks, exact_dedup, mixing, quality, simhash
from bazaarline.llm.queries import BYTE_BPE, with_digests
from bazaarline.llm.storage import drop, finished, work_tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike texts the document with the smallest id stays.

    Shingles of five words and a likeness of 0.8 or more: fingerprints of several
    words find candidates, whose whole sets of shingles are compared.
    """
    return simhash.drop_alike(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their targets; a document may come several times or not at all."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each drawn document, with digests of ids and decoded text."""
    coded = bpe_chunks.decode(bpe_chunks.encode(docs, BYTE_BPE), BYTE_BPE)
    return with_digests(coded)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: SQL can neither train the classifier nor encode; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``. A stage's work tables go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with work_tables() as made:
            docs = finished(stage(spark, docs, sf_dir), f"pipeline-{k}", made)
        if before:
            drop(spark, before)
        before = made[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
