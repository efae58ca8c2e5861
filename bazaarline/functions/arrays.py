"""Arrays, bit strings and semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), "+")


def prefix_exists(left: Column, right: Column, least: int = 4) -> Column:
    """Whether a token of ``left``, at least so long, begins one of ``right``."""
    return F.exists(left, lambda a: (F.length(a) >= least) & F.exists(right, lambda b: b.startswith(a)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; null if either is null or of length 0."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return product(a, b) / F.nullif(F.sqrt(product(a, a)) * F.sqrt(product(b, b)), F.lit(0.0))


def hamming_likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two bit strings of the same length, else null."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a))


def level_likeness(a: Column, b: Column, most: int = 255) -> Column:
    """One minus the mean absolute difference of two arrays of levels."""
    off = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), 1 - off / (F.size(a) * most))


def mean_hash(levels: Column) -> Column:
    """Bit string: which levels are at least the mean."""
    mean = F.aggregate(levels, F.lit(0.0), lambda s, x: s + x) / F.size(levels)
    return F.array_join(F.transform(levels, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def step_hash(levels: Column, width: int) -> Column:
    """Bit string: which levels exceed their right neighbour in the row."""
    pairs = F.filter(F.sequence(F.lit(1), F.size(levels) - 1), lambda k: k % width != 0)
    return F.array_join(F.transform(pairs, lambda k: F.when(F.element_at(levels, k) > F.element_at(levels, k + 1), "1").otherwise("0")), "")


def first_price(prices: Column, kinds: tuple[str, ...] = ("market", "mid", "low")) -> Column:
    return F.coalesce(*[F.try_element_at(prices, F.lit(k)) for k in kinds])


def first_object(text: Column) -> Column:
    """The first ``{...}`` of a model's answer, without control characters."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*\}", 0), r"[\x00-\x1F]", ""), F.lit(""))


def price_of(json: Column) -> Column:
    """Price that is a number, a string or an object with an amount."""
    return F.coalesce(F.get_json_object(json, "$.price.amount"), F.get_json_object(json, "$.price")).try_cast("double")
