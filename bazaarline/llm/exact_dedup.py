"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

The first scan counts lengths. Only documents whose length another one has go
on to be grouped by prefix hash in the second, and only what shares both with
another document has its full content hashed in the third. Scans know the
survivors of the one before by bitmaps, so texts are never shuffled to find
duplicates. Each scan counts pre-aggregated keys only.

Defined cases: null text counts as empty; equal means identical after each run
of ASCII white space became one space; a null id ranks after all others; of
repeated rows (same id, same text) one stays; other columns are never looked at,
so names such as ``_len`` in the input can't clash: they are dropped before use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import MOST, bitmap, filtered, with_membership
from .storage import keep

SPACES = r"[\x20\x09-\x0D]+"
#: Code points of the normalised text that the prefix hash covers.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _key(prefix_chars: int) -> Column:
    return F.xxhash64("_len", F.xxhash64(F.substring("_norm", 1, prefix_chars)))


def _suspects(docs: DataFrame, text: str, prefix_chars: int, most: int) -> DataFrame:
    """Digests ``_key`` of the (length, prefix hash) pairs that two documents or more share."""
    lengths = docs.select(F.length(normalised(F.col(text))).cast("long").alias("_len")).groupBy("_len").agg(F.count(F.lit(1)).alias("_n"))
    lengths = keep(lengths.where("_n > 1").select("_len"), "dedup-lengths")
    rows = docs.select(normalised(F.col(text)).alias("_norm")).withColumn("_len", F.length("_norm").cast("long"))
    heads = filtered(rows, lengths, "_len", most).select(_key(prefix_chars).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return keep(heads.where("_n > 1").select("_key"), "dedup-prefixes")


def _keyed(docs: DataFrame, text: str, prefix_chars: int, most: int) -> DataFrame:
    """``docs`` with ``_norm``, ``_len`` and ``_suspect``: whether the full content has to be hashed."""
    marks = bitmap(_suspects(docs, text, prefix_chars, most), "_key", most)
    keyed = docs.withColumn("_norm", normalised(F.col(text))).withColumn("_len", F.length("_norm").cast("long")).withColumn("_key", _key(prefix_chars))
    return with_membership(keyed, marks, "_key", "_suspect")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_len", "_full").agg(F.min("_id").alias("keep_id"), F.sum("_same").alias("group_size"))


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, prefix_chars: int = PREFIX_CHARS, most: int = MOST
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept; with ``digest`` also text_sha256.

    ``keep_id`` is the smallest id of the group of equal texts.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _keyed(own, "_text", prefix_chars, most)
    full = F.sha2(F.col("_norm"), 256)
    rows = rows.select("_id", "_len", "_suspect", F.when(F.col("_suspect"), full).alias("_full"), *([full.alias("text_sha256")] if digest else []))
    rows = keep(rows, "dedup-rows")
    more = ["text_sha256"] if digest else []
    alone = rows.where("not _suspect").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    # repeated rows are one counted row until the end
    same = rows.where("_suspect").groupBy("_id", "_len", "_full").agg(F.count(F.lit(1)).alias("_same"))
    same = keep(same, "dedup-same")
    groups = keep(_groups(same), "dedup-groups")
    joined = same.join(groups, ["_len", "_full"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    found = joined.select(F.col("_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), *[F.col("_full").alias(m) for m in more])
    return alone.unionByName(found)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Only suspects' rows are shuffled."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _keyed(boxed, "_text", prefix_chars, most).withColumn("_full", F.when(F.col("_suspect"), F.sha2("_norm", 256)))
    small = keep(rows.where("_suspect").groupBy("_id", "_len", "_full").agg(F.count(F.lit(1)).alias("_same")), "dedup-same")
    stay = _groups(small).select("_len", "_full", F.coalesce(F.col("keep_id").cast("string"), F.lit("null")).alias("_keep"))
    suspects = rows.where("_suspect").withColumn("_keep", F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    chosen = suspects.join(stay, ["_len", "_full", "_keep"], "left_semi")
    chosen = chosen.groupBy("_len", "_full", "_keep").agg(F.first("_row").alias("_row"))
    return rows.where("not _suspect").select("_row.*").unionByName(chosen.select("_row.*"))
