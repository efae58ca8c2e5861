"""Features of things that aren't cards: what must agree before two titles can be of the same item.

:func:`features` reads all of them from a title into one typed struct;
:func:`rejections` compares the structs of two titles field by field, by the rules of
the category. A field that either title doesn't tell never rejects. Null and empty
titles tell nothing, and a null or other category has no rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip_accents, word

#: Names of consoles and what they stand for; the first that a title contains counts.
CONSOLES = (
    ("game boy color", "gbc"), ("game boy colour", "gbc"), ("game boy advance sp", "gbasp"), ("gba sp", "gbasp"), ("game boy advance", "gba"),
    ("game boy pocket", "gbp"), ("game boy", "gb"), ("nintendo 64", "n64"), ("n64", "n64"), ("super nintendo", "snes"), ("snes", "snes"),
    ("super nes", "snes"), ("playstation 5", "ps5"), ("ps5", "ps5"), ("playstation 4", "ps4"), ("ps4", "ps4"), ("playstation 3", "ps3"),
    ("ps3", "ps3"), ("playstation 2", "ps2"), ("ps2", "ps2"), ("playstation vita", "psvita"), ("psvita", "psvita"),
    ("playstation portable", "psp"), ("psp", "psp"), ("playstation 1", "ps1"), ("playstation one", "ps1"), ("ps1", "ps1"), ("psx", "ps1"),
    ("mega drive", "megadrive"), ("sega genesis", "megadrive"), ("neo geo", "neogeo"), ("game gear", "gamegear"),
    ("atari 2600", "atari2600"), ("atari 7800", "atari7800"),
)
#: Product lines of football cards, in the order in which they are looked for.
LINES = (
    "national treasures", "topps chrome", "topps merlin", "topps heritage", "topps finest", "topps ucc", "turbo attax", "stadium club",
    "prizm", "donruss", "select", "mosaic", "chronicles", "optic", "panini gold standard", "panini honors",
)
#: Clothing brands, in the order in which they are looked for.
BRANDS = (
    "ralph lauren", "polo sport", "north face", "nuptse", "carhartt", "stone island", "arcteryx", "arc'teryx", "patagonia", "burberry",
    "cp company", "lacoste", "fred perry", "barbour", "woolrich",
)
#: What titles call new and used things, originals and reissues, as patterns.
NEW = "neuf|neuve|new|mint|sealed|scelle|jamais utilise|deadstock|ds|vnds|like new"
USED = "occasion|used|wear|worn|use|cracked|casse|rayure|abime|defaut|traces|pour pieces"
ORIGINAL = r"original|originale|first\s*press(?:ing)?|premiere\s*press|1st\s*press|og"
REISSUE = "reissue|repress|re.?edition|remaster(?:ed)?"
#: Shoe sizes of Britain and the US are so much less than European ones, roughly.
TO_EUROPEAN = 33

#: Fields that must agree, by category in lower case.
RULES = {
    "sneakers": ("shoe_size",),
    "vetements vintage": ("brand", "clothing_size"),
    "lego": ("set_number",),
    "tech": ("condition",),
    "consoles retro": ("condition", "console"),
    "vinyles": ("edition",),
    "topps chrome football": ("product_line",),
    "panini football": ("product_line",),
}


def _found(text: Column, pattern: str) -> Column:
    """The pattern's group, null if it isn't there."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _first_of(text: Column, names) -> Column:
    return F.coalesce(*[F.when(text.contains(name), F.lit(value)) for name, value in names])


def shoe_size(plain: Column) -> Column:
    """European size from 35 to 50 in whole numbers; else a British or American one, turned into one."""
    european = _found(plain, word(r"(?:eu|taille|pointure|size|sz|t\.?)?\s*(3[5-9]|4[0-9]|50)(?:[.,]5)?")).cast("double")
    other = lambda place: F.replace(_found(plain, word(place + r"\s*([0-9]{1,2}(?:[.,][0-9])?)")), F.lit(","), F.lit(".")).try_cast("double") + TO_EUROPEAN
    return F.coalesce(european, other("uk"), other("us"))


def set_number(title: Column) -> Column:
    """The first number of four to six digits that is from 1,000 to 99,999 and no year around now (2000 to 2030)."""
    numbers = F.regexp_extract_all(title, F.lit(word("([0-9]{4,6})")), F.lit(1))
    value = lambda x: x.cast("int")
    return F.try_element_at(F.filter(numbers, lambda x: value(x).between(1000, 99_999) & ~value(x).between(2000, 2030)), F.lit(1))


def features(title: Column) -> Column:
    """All features of a title as one struct; a field is null where the title doesn't tell it."""
    raw = F.coalesce(title, F.lit(""))
    plain = strip_accents(F.lower(raw))
    fields = {
        "shoe_size": shoe_size(plain),
        "clothing_size": F.coalesce(F.upper(_found(plain, word("(xxs|xs|xxl|xl|s|m|l)"))), _found(plain, word("(3[6-9]|4[0-9]|50|52)"))),
        "condition": F.when(plain.rlike(word(NEW)), "new").when(plain.rlike(word(USED)), "used"),
        "set_number": set_number(raw),
        "console": _first_of(plain, CONSOLES),
        "original": plain.rlike(word(ORIGINAL)),
        "reissue": plain.rlike(word(REISSUE)),
        "product_line": _first_of(plain, [(x, x) for x in LINES]),
        "brand": _first_of(plain, [(x, x) for x in BRANDS]),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _conflict(field: str, a: Column, b: Column) -> Column:
    if field == "edition":
        return (a["original"] & b["reissue"]) | (a["reissue"] & b["original"])
    if field == "shoe_size":
        return F.abs(a[field] - b[field]) > 0.5
    return a[field] != b[field]


def rejections(a: Column, b: Column, category: Column) -> Column:
    """Names of the fields by which two structs of features can't be of one item, in the order of the rules."""
    kind = F.lower(category)
    fields = dict.fromkeys(f for own in RULES.values() for f in own)
    tests = []
    for field in fields:
        where = [c for c, own in RULES.items() if field in own]
        tests.append(F.when(kind.isin(*where) & _conflict(field, a, b), F.lit(field)))
    return F.array_compact(F.array(*tests))
