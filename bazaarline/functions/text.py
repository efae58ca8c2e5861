"""Text shaping with ASCII word borders, whatever the engine's own idea of a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain ones that they decompose to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Entities in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&lt;", "<"), ("&gt;", ">"))


def strip_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def word(pattern: str) -> str:
    """``pattern`` between ASCII word borders."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def normalize_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s ]+", " "))


def slug_tokens(x: Column) -> Column:
    """Lower-case tokens of letters, digits, ``/``, ``#`` and ``-``."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(x, F.lit("")))), F.lit("[a-z0-9/#-]+"), F.lit(0))


def comparable_token(t: Column) -> Column:
    """Without ``#`` and leading zeros; both sides of a serial alike."""
    bare = F.regexp_replace(F.lower(t), "#", "")
    return F.regexp_replace(bare, r"(^|/)0+(?=[0-9])", "$1")


def title_key(x: Column, length: int, keep_spaces: bool = True) -> Column:
    """Key for telling titles apart: plain lower-case letters and digits, cut at ``length``."""
    plain = F.regexp_replace(strip_accents(F.lower(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " " if keep_spaces else "")
    return F.substring(F.trim(plain), 1, length)


def product_key(x: Column) -> Column:
    """Dash-joined key of a product name, at most 150 long, else ``unknown``."""
    plain = F.regexp_replace(strip_accents(F.lower(F.coalesce(x, F.lit("")))), r"[^a-z0-9\s/\-#]", " ")
    key = F.substring(F.regexp_replace(F.trim(plain), r"\s+", "-"), 1, 150)
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))


def safe_id(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", "_"), 1, 100)


def decode_entities(x: Column) -> Column:
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def euro_amount(x: Column) -> Column:
    """Number in free text: the last of ``,`` and ``.`` before at most two digits is the decimal point."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s ]", ""), r"[0-9][0-9.,]*", 0)
    whole, part = F.regexp_extract(found, r"^(.*)[.,]([0-9]{1,2})$", 1), F.regexp_extract(found, r"^(.*)[.,]([0-9]{1,2})$", 2)
    split = F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), part)
    return F.when(part != "", split.try_cast("double")).otherwise(F.regexp_replace(found, "[.,]", "").try_cast("double"))


def first_match(x: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first rule any of whose keywords ``x`` contains."""
    out = None
    for name, keywords in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | x.contains(k)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
