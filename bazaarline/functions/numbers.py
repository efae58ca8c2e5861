"""Rounding, ladders and statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = int | float
#: Euro rates of the page path and of the API path.
EURO_RATES = {"EUR": 1.0, "USD": 0.865, "GBP": 1.153}
EURO_RATES_API = {**EURO_RATES, "CAD": 0.67, "AUD": 0.58}


def js_round(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity, on doubles; the built-in rounds half away from zero."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def or_else(x: Column, other: Column | Number) -> Column:
    """``x || other`` on numbers: zero counts as missing."""
    other = other if isinstance(other, Column) else F.lit(other)
    return F.coalesce(F.when(x != 0, x), other)


def clamp(x: Column, low: Number, high: Number) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ladder(x: Column, steps: list[tuple[str, Number, Column | Number]], otherwise: Column | Number | None) -> Column:
    """First hit wins: (comparison, bound, value) in order; a null ``x`` gives ``otherwise``."""
    compare = {">=": lambda b: x >= b, ">": lambda b: x > b, "<=": lambda b: x <= b, "<": lambda b: x < b, "=": lambda b: x == b}
    out = None
    for how, bound, value in steps:
        test = compare[how](F.lit(bound))
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def cents(x: Column) -> Column:
    return js_round(x * 100).cast("long")


def mean_cents(x: Column) -> Column:
    """Aggregate: mean of money, summed as whole cents so that the order of rows doesn't matter."""
    return F.sum(cents(x)).cast("double") / F.count(x) / 100


def median_mid(x: Column) -> Column:
    """Aggregate, median A: the mean of the two middle values."""
    return F.median(x)


def at_quantile(x: str, q: float) -> Column:
    """Aggregate: the value of column ``x`` at ``floor(n * q)`` of the sorted ones, counted from 0.

    Counted from above that is place ``ceil(n * (1 - q))``, which the built-in gives.
    It holds each different value of a group once, with its count, pre-aggregated.
    """
    return F.expr(f"percentile_disc({1 - q}) WITHIN GROUP (ORDER BY {x} DESC)")


def median_upper(x: str) -> Column:
    """Aggregate, median B: the upper middle value of column ``x``."""
    return at_quantile(x, 0.5)


def variation(x: Column) -> Column:
    """Aggregate: population deviation over mean; null below two values or at mean zero."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)))


def euros(amount: Column, currency: Column, rates: dict[str, float] = EURO_RATES, otherwise: str | None = None) -> Column:
    """Amount in euros; an unknown currency gives null or the rate of ``otherwise``."""
    table = F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])
    rate = F.try_element_at(table, F.upper(currency))
    if otherwise:
        rate = F.coalesce(rate, F.lit(rates[otherwise]))
    return js_round(amount * rate, 2)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, null where ``whole`` is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
