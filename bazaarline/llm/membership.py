"""Membership bitmaps: broadcasts whose size follows their keys, up to a fixed most.

A bitmap marks hashed keys. A key whose bit is unset is surely not a member, so
its row can be handled where it lies, without moving its text; a key whose bit is
set may be a member and goes the exact way. A bitmap has ``PER_KEY`` bits for
each key, so about one row in ``PER_KEY`` takes the exact way in vain, and never
more than ``MOST`` bits; beyond so many keys more rows take the exact way, and
results stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one row of a bitmap; what ``bitmap_construct_agg`` fills.
ROW_BITS = 32_768
#: Bits for each key; most bits of a bitmap: 2**30 are 128 MB.
PER_KEY, MOST = 16, 1 << 30


@dataclass(frozen=True)
class Bitmap:
    """``rows`` (_block, _bits) of a bitmap of ``bits`` bits; none for blocks without a key."""

    rows: DataFrame
    bits: int


def bits_for(n: int, most: int = MOST) -> int:
    """The power of two that gives ``n`` keys their bits."""
    return max(ROW_BITS, min(most, 1 << max(0, n * PER_KEY - 1).bit_length()))


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def bitmap(keys: DataFrame, key: str, most: int = MOST) -> Bitmap:
    """Marks the long column ``key`` of ``keys``, a written table (it is counted first)."""
    if most % ROW_BITS:
        raise ValueError(f"most must be a multiple of {ROW_BITS}")
    bits = bits_for(keys.count(), most)
    slot = _slot(F.col(key), bits)
    rows = (
        keys.where(F.col(key).isNotNull())
        .select(F.floor(slot / ROW_BITS).cast("int").alias("_block"), (slot % ROW_BITS).alias("_pos"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_pos").alias("_bits"))
    )
    return Bitmap(rows, bits)


def with_membership(df: DataFrame, marks: Bitmap, key: str, out: str) -> DataFrame:
    """Adds boolean ``out``: false if the long ``key`` is surely not among the marked ones."""
    slot = _slot(F.col(key), marks.bits)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_block", F.floor(slot / ROW_BITS).cast("int"))
        .withColumn("_pos", (slot % ROW_BITS).cast("int"))
        .join(F.broadcast(marks.rows), "_block", "left")
        .withColumn(out, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("_pos") % 8).cast("int")) > 0, F.lit(False)))
        .drop("_block", "_pos", "_bits")
    )


def filtered(df: DataFrame, keys: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """The rows of ``df`` whose long ``key`` is among the ones of ``keys``, a written table, and few others."""
    return with_membership(df, bitmap(keys, key, most), key, "_member").where("_member").drop("_member")
