"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects ``target / source_size`` copies. Summed up in
order within the source, from one random offset on, a document is emitted once
for each integer that the sum passes while it is added. Documents are taken in
order of size, then of a digest of id and text, so each source's words come near
its target and reruns agree.

The running sum of a hot source isn't made in one task: documents are dealt to
blocks (source, size class, bucket of the digest), ranked in their block, and blocks
are pre-aggregated rows whose own running sum is small. Sizes of sources and blocks
count every document. Sources are a dimension: their targets come from one sort of
a row per source.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; sources of size 0 have target 0 and give no copies; null ids are
mixed like others; repeated rows count and are drawn each; an empty table gives
no rows; columns are boxed, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Targets stop at so many times their source's size.
MOST = 3
#: Source weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
SEED = 20240


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: str) -> Column:
    """Sizes within an eighth of an octave share a class."""
    return F.expr(f"CASE WHEN {size} < 16 THEN {size} ELSE length(bin({size})) * 8 + shiftright({size}, length(bin({size})) - 4) % 8 END").cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(_source, source_size) of all sources to the same with ``target``.

    The excess of capped sources is reshared by weight until none is above its
    cap: in order of cap per weight the capped ones come first, and the level of
    the others follows from running sums. One row per source.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(most))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    share = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    levels = capped.withColumn("_level", left.cast("double") / share.cast("double"))
    free = F.when(F.col("_cap") / F.col("_weight") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))
    level = F.min(free).over(every)["_level"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_weight"), F.col("_cap").cast("double")))
    return levels.withColumn("target", target).select("_source", "source_size", "target")


def with_copies(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(_row, _id, size, source_size, target, copies) per document; ``_row`` is a struct of the ``carry`` columns."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary"))
    box = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(box.alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), words(F.col(text_col)).alias("size"), key.alias("_md5"))
    rows = rows.withColumn("_class", _size_class("size"))
    rows = rows.withColumn("_bucket", F.concat(F.substring("_md5", 1, 1), F.translate(F.substring("_md5", 2, 1), "0123456789abcdef", "0000111122223333")))
    rows = rows.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n")))
    if not carry:  # without texts it is cheaper to keep the rows than to count words twice
        rows = keep(rows, "mix-rows")
    block = ["_src", "_class", "_bucket"]
    blocks = keep(rows.groupBy(*block).agg(F.first("_source").alias("_source"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")), "mix-blocks")
    sources = blocks.groupBy("_src").agg(F.first("_source").alias("_source"), F.sum("_words").alias("source_size"))
    targets = keep(source_targets(sources.select("_source", "source_size"), weights, most), "mix-targets")
    targets = targets.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).drop("_source")
    earlier = Window.partitionBy("_src").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_src")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    blocks = keep(blocks.join(targets, "_src").withColumn("_offset", offset), "mix-offsets")
    inside = Window.partitionBy(*block).orderBy("size", "_md5")
    # rows lie by block already, so only the other side moves; merging never gathers it on the driver
    ranked = rows.withColumn("_in_block", F.row_number().over(inside)).join(blocks.hint("merge"), block)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("_before") + F.col("_in_block")
    crossed = F.floor(rate * upto + F.col("_offset")) - F.floor(rate * (upto - 1) + F.col("_offset"))
    return ranked.select("_row", "_id", "size", "source_size", "target", F.least(crossed, F.ceil(rate)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it was drawn."""
    drawn = with_copies(docs, docs.columns, id_col, text_col, source_col, **how).where("copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
