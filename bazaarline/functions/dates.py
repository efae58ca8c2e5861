"""Dates and durations; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months in English, French, German, Spanish and Italian, without accents.
MONTHS = (
    "jan january janvier janv januar enero ene gennaio gen", "feb february fevrier fevr februar febrero febbraio", "mar march mars marz maerz marzo",
    "apr april avril avr abril abr aprile", "may mai mayo maggio mag", "jun june juin juni junio giugno giu", "jul july juillet juil juli julio luglio lug",
    "aug august aout agosto ago", "sep sept september septembre septiembre settembre set", "oct october octobre oktober okt octubre ottobre ott",
    "nov november novembre noviembre", "dec december decembre dezember dez diciembre dic dicembre",
)


def month_number(name: Column) -> Column:
    """1 to 12 of a lower-case month name without accents, else null."""
    table = F.create_map(*[F.lit(v) for k, names in enumerate(MONTHS, 1) for n in names.split() for v in (n, k)])
    return F.try_element_at(table, name)


def localised_date(text: Column) -> Column:
    """Date in a caption such as ``Vendu le 12 mars 2024`` or ``Sold Mar 12, 2024``; null if there is none."""
    from .text import strip_accents

    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    european, english = r"([0-9]{1,2})[.\s]+(?:de\s+)?([a-z]{3,10})[.\s]+(?:de\s+)?([0-9]{4})", r"([a-z]{3,10})[.\s]+([0-9]{1,2}),?\s+([0-9]{4})"
    part = lambda pattern, k: F.regexp_extract(plain, pattern, k)
    date = lambda y, m, d: F.try_make_timestamp(y.try_cast("int"), month_number(m), d.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(date(part(european, 3), part(european, 2), part(european, 1)), date(part(english, 3), part(english, 1), part(english, 2)))


def whole_days(since: Column, until: Column) -> Column:
    """Days that have passed entirely; unlike ``datediff`` the time of day counts."""
    return F.floor((F.unix_micros(until) - F.unix_micros(since)) / 86_400_000_000)


def months_ago(since: Column, until: Column) -> Column:
    return (F.year(until) - F.year(since)) * 12 + F.month(until) - F.month(since)


def next_weekly(now: Column, weekday: int, hour: int) -> Column:
    """Next time that it is ``hour`` on ``weekday`` (0 is Sunday), later than ``now``."""
    ahead = F.pmod(F.lit(weekday) - (F.dayofweek(now) - 1), F.lit(7))
    at = F.timestamp_add("HOUR", F.lit(hour), F.timestamp_add("DAY", ahead, F.date_trunc("day", now)))
    return F.when(at > now, at).otherwise(F.timestamp_add("DAY", F.lit(7), at))


def duration(seconds: Column) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    text = lambda x: x.cast("string")
    return F.when(h > 0, F.concat(text(h), F.lit("h "), text(m), F.lit("m"))).when(m > 0, F.concat(text(m), F.lit("m "), text(s), F.lit("s"))).otherwise(F.concat(text(s), F.lit("s")))


def season(now: Column) -> Column:
    month = F.month(now)
    return F.when(month.isin(11, 12), "holiday").when(month.between(6, 8), "summer").otherwise("regular")
