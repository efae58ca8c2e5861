"""Personal data and the terms that give it away, in DataFrame operations only.

Base spans (email, ip, card, phone) come from patterns. What is to be protected
are their values and the classes these belong to (see :func:`_entities`), so that
a value too rare to be judged alone is judged with its like. Terms are words and
numbers of two letters or digits or more outside base spans. Counted over whole
texts and the whole corpus, a term t discloses an entity e by the share of the
entity's information that it carries, PMI(t; e) / IC(e) with IC(e) = -log2 p(e).
As few documents are little evidence, p(e | t) is not the raw share but the lower
end of its Wilson interval, where only different texts count as observations; and
a rule needs it to be ``LIKELY`` at least, so that at most a bit is left in doubt.
Every occurrence of a term in the documents of the entity is a span: at
``GENERALISE`` or more it is replaced by its kind, at ``REMOVE`` or more it is
taken out.

Spark's expressions give matches and what lies between them; positions are
running sums of their lengths. Patterns start only where a run of their
characters starts and never give back what they took, so long runs cost linear
time. Documents without an entity are never shuffled with their texts, and
documents are known by two hashes of their text, so copies share one answer.

Two bounds that follow from the thresholds keep pairs few: an entity or term of
fewer than three texts can't reach ``LIKELY``, nor a term in more than
``1 / LIKELY`` times as many documents as the entity.

Defined cases: null text counts as empty and has no spans; repeated rows get a
row each; an empty table gives no rows; columns other than id and text are not
read by the search and stay as they are in ``sanitise``.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import filtered
from .storage import keep

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information from which a term is generalised or removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Least p(e | t) of a rule, and how many standard deviations its estimate is lowered by.
LIKELY, DEVIATIONS = 0.5, 1.64
#: With all texts on its side, an estimate reaches ``LIKELY`` from so many on.
LEAST_TEXTS = ceil(DEVIATIONS**2 * LIKELY / (1 - LIKELY))
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # runs of fewer than 12 digits fail anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched at all.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring({d}, length({d}) + 1 - i, 1) AS int) "
    "WHEN substring({d}, length({d}) + 1 - i, 1) > '4' THEN 2 * cast(substring({d}, length({d}) + 1 - i, 1) AS int) - 9 "
    "ELSE 2 * cast(substring({d}, length({d}) + 1 - i, 1) AS int) END) % 10 = 0"
)
_CARD_DIGITS, _ALL_DIGITS = "regexp_replace(x.hit, '[ -]', '')", "regexp_replace(x.hit, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"forall(split(x.hit, '\\.'), p -> coalesce(try_cast(p AS bigint) <= 255, false))",
    "card": f"(CASE WHEN length({_CARD_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN.format(d=_CARD_DIGITS)} ELSE false END)",
    "phone": f"length({_ALL_DIGITS}) BETWEEN 9 AND 15",
}
_WORDS = r"[\p{L}\p{N}]{2,}"


#: Elements that an array or text is put together from at a time.
BLOCK = 256
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _running(items: str, step: str) -> str:
    """SQL: for each of ``items`` (``x``) the number ``acc.at`` before it, then carried on by ``step``; one more for the end.

    A fold copies what it has so far at each step. So it has numbers only, and an array of its own for each block.
    """
    block = f"aggregate(slice(h.items, k * {BLOCK} + 1, {BLOCK}), named_struct('at', outer.at, 'out', cast(array() AS array<int>)), (acc, x) -> named_struct('at', {step}, 'out', concat(acc.out, array(acc.at))), acc -> named_struct('at', acc.at, 'outs', concat(outer.outs, array(acc.out))))"
    blocks = f"aggregate(sequence(0, greatest(0, size(h.items) - 1) div {BLOCK}), named_struct('at', 0, 'outs', cast(array() AS array<array<int>>)), (outer, k) -> {block}, r -> concat(flatten(r.outs), array(r.at)))"
    return f"transform(array(named_struct('items', {items})), h -> {blocks})[0]"  # the items are named, so they are made once


def _located(text: str, hits: str, pattern_sql: str, valid: str, kind: int) -> str:
    """SQL: spans (start, kind, end, value) of the valid ones of ``hits``; what lies between them gives the places."""
    items = f"zip_with(split({text}, {pattern_sql}, -1), {hits}, (gap, hit) -> named_struct('gap', gap, 'hit', hit))"
    starts = _running("g.items", "acc.at + coalesce(length(x.gap), 0) + coalesce(length(x.hit), 0)")
    placed = f"zip_with(g.items, {starts}, (y, at) -> named_struct('start', at + length(y.gap), 'kind', {kind}, 'end', at + length(y.gap) + length(y.hit), 'hit', y.hit))"
    return f"cast(transform(array(named_struct('items', {items})), g -> filter({placed}, x -> x.hit IS NOT NULL AND {valid}))[0] AS {_SPANS})"


def _uncovered(spans: str, base: str) -> str:
    """SQL: those of ``spans`` that no span of ``base``, sorted by start, overlaps: the farthest end of all that begin before is found by halving."""
    middle = "cast((a.lo + a.hi) div 2 AS int)"
    halve = f"CASE WHEN a.lo >= a.hi THEN a WHEN s.base[{middle}].start < t.end THEN named_struct('lo', {middle} + 1, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', {middle}) END"
    before = f"aggregate(sequence(0, length(bin(size(s.base)))), named_struct('lo', 0, 'hi', size(s.base)), (a, i) -> {halve}, a -> a.lo)"
    reach = _running(base, "greatest(acc.at, x.end)")  # before each span; so the one at ``before`` is of all spans before it
    return f"transform(array(named_struct('spans', {spans}, 'base', {base}, 'reach', {reach})), s -> filter(s.spans, t -> s.reach[{before}] <= t.start))[0]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_base_spans(docs: DataFrame, text: str = "_text") -> DataFrame:
    """``docs`` with ``_base``: all base spans by start, then kind."""
    none = f"cast(array() AS {_SPANS})"
    for kind in KINDS:
        pattern = _literal(_PATTERNS[kind])
        need = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(_NEEDS[kind])
        docs = docs.withColumn(f"_{kind}", F.when(need, F.expr(f"regexp_extract_all({text}, {pattern}, 0)")))
    parts = []
    for k, kind in enumerate(KINDS):
        located = _located(text, f"_{kind}", _literal(_PATTERNS[kind]), _VALID[kind], k)
        parts.append(F.expr(f"CASE WHEN size(_{kind}) > 0 THEN {located} ELSE {none} END"))
    return docs.withColumn("_base", F.array_sort(F.concat(*parts))).drop(*[f"_{kind}" for kind in KINDS])


def _entities(base: str) -> Column:
    """The values of base spans and their classes, different ones: the kind; an address's domain and the parts of its name; an ip's first three numbers; a card's first six digits; a phone without its last four."""
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    mail = "lower(s.value)"
    name = f"filter(split(substring_index({mail}, '@', 1), '[._%+-]+'), x -> length(x) >= 2)"
    of_kind = [
        f"concat(array(concat('email:', {mail}), concat('domain:', substring_index({mail}, '@', -1))), transform({name}, x -> concat('name:', x)))",
        "array(concat('ip:', s.value), concat('net:', substring_index(s.value, '.', 3)))",
        f"array(concat('card:', {digits}), concat('issuer:', substring({digits}, 1, 6)))",
        f"array(concat('phone:', {digits}), concat('exchange:', substring({digits}, 1, length({digits}) - 4)))",
    ]
    cases = " ".join(f"WHEN {k} THEN concat({of_kind[k]}, array('{kind}'))" for k, kind in enumerate(KINDS))
    return F.expr(f"array_distinct(flatten(transform({base}, s -> CASE s.kind {cases} END)))")


def _outside(text: str) -> str:
    """SQL: the text with whatever looks like a base span blanked out."""
    for kind in KINDS:
        text = f"regexp_replace({text}, {_literal(_PATTERNS[kind])}, ' ')"
    return text


def likely(n_te: Column, n_t: Column, texts: Column) -> Column:
    """Lower end of the Wilson interval of n_te / n_t, where ``texts`` of the ``n_te`` documents differ."""
    p, z2 = n_te / n_t, F.lit(DEVIATIONS**2)
    n = texts / p  # different texts with the term, by the same share
    return (p + z2 / (2 * n) - DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing_terms(docs: DataFrame, words: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of all pairs with at least ``LIKELY``; documents are counted over the whole corpus.

    ``docs`` has ``_text`` of all documents; ``words`` and ``entities`` have a row per
    different text (_k1, _k2, of _n documents) and term or entity.
    """
    several = F.col("texts") >= LEAST_TEXTS
    known = keep(entities.groupBy("entity").agg(F.sum("_n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(several).drop("texts"), "pii-entities")
    terms = keep(words.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(several).select("term", F.xxhash64("term").alias("_key")), "pii-terms")
    every = docs.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(_text), {_literal(_WORDS)}, 0)"))).alias("term")).withColumn("_key", F.xxhash64("term"))
    counts = filtered(every, terms, "_key").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counts = keep(counts.join(terms.select("term"), "term", "left_semi"), "pii-counts")
    one = words.join(counts, "term")
    two = entities.select("_k1", "_k2", "entity").join(known, "entity")
    pairs = one.join(two, ["_k1", "_k2"]).where(F.col("n_t") * LIKELY <= F.col("n_e"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("_n").alias("n_te"), F.count(F.lit(1)).alias("texts"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.where(several).crossJoin(F.broadcast(total))  # one row
    # a copy of a text that another text's words are counted in as well can't make the share exceed 1
    joined = joined.withColumn("p", likely(F.col("n_te"), F.greatest("n_t", "n_te"), F.col("texts")))
    information = F.log2(F.col("n") / F.col("n_e"))
    disclosure = F.when(information > 0, (F.log2("p") + information) / information).otherwise(F.lit(0.0))
    return joined.where(F.col("p") >= LIKELY).select("entity", "term", disclosure.alias("disclosure"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: _id, _base (spans) and _terms (spans with the action as value); ``carry`` puts columns into struct ``_row``."""
    box = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []
    own = docs.select(*box, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = with_base_spans(own).withColumn("_k1", F.xxhash64("_text")).withColumn("_k2", F.xxhash64(F.lit(1), F.reverse("_text")))
    entity = F.size("_base") > 0
    text = ["_k1", "_k2"]
    private = rows.where(entity).select(*text, "_text", "_base")
    copies = keep(private.groupBy(*text).agg(F.count(F.lit(1)).alias("_n"), F.first("_text").alias("_text"), F.first("_base").alias("_base")), "pii-texts")
    found = F.array_distinct(F.expr(f"regexp_extract_all(lower({_outside('_text')}), {_literal(_WORDS)}, 0)"))
    words = keep(copies.select(*text, "_n", F.explode(found).alias("term")), "pii-words")
    entities = keep(copies.select(*text, "_n", F.explode(_entities("_base")).alias("entity")), "pii-protected")
    rules = disclosing_terms(own.select("_text"), words, entities).where(F.col("disclosure") >= GENERALISE)
    rules = keep(rules.withColumn("action", F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))), "pii-rules")
    told = words.select(*text, "term").join(rules, "term").join(entities.select(*text, "entity"), [*text, "entity"])
    told = told.groupBy(*text, "term").agg(F.max("action").alias("action"))  # "remove" is the greater
    told = told.groupBy(*text).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_told"))  # of one text
    marked = copies.join(told, text).withColumn("_hits", F.expr(f"regexp_extract_all(_text, {_literal(_WORDS)}, 0)"))
    places = _located("_text", "_hits", _literal(_WORDS), "map_contains_key(_told, lower(x.hit))", len(KINDS))
    # a term inside a base span is covered by it
    acted = f"transform({_uncovered(places, '_base')}, t -> named_struct('start', t.start, 'kind', t.kind, 'end', t.end, 'value', _told[lower(t.value)]))"
    terms = keep(marked.select(*text, F.expr(acted).alias("_terms")), "pii-spans")
    shown = [*(["_row"] if carry else []), "_id", "_text", "_base", "_terms"]
    none = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>)")
    kept_text = F.col("_text") if carry else F.lit(None).cast("string")
    clean = rows.where(~entity).withColumn("_terms", none)
    touched = rows.where(entity).withColumn("_text", kept_text).join(terms, text, "left").withColumn("_terms", F.coalesce("_terms", none))
    return clean.select(*shown).unionByName(touched.select(*shown))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts by kind, digest of the base spans, all spans."""
    found = find(docs, id_col, text_col)
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.concat("_base", "_terms"))
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "sanitised") -> DataFrame:
    """``docs`` with the text whose entities are replaced by their kind, and whose disclosing terms are generalised or removed."""
    found = find(docs, id_col, text_col, carry=docs.columns)
    found = found.withColumn("_all", F.array_sort(F.concat("_base", "_terms")))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in (*KINDS, TERM)) + ")"
    # pieces are cut from the text of their block, as a cut counts characters from the start
    piece = f"concat(acc.out, substring(b.text, acc.at - b.at + 1, x.start - acc.at), CASE WHEN x.value = 'remove' AND x.kind = {len(KINDS)} THEN '' ELSE element_at({names}, x.kind + 1) END)"
    step = f"CASE WHEN x.start < acc.at THEN acc ELSE named_struct('at', x.end, 'out', {piece}) END"
    block = f"transform(array(named_struct('at', outer.at, 'own', slice(_all, k * {BLOCK} + 1, {BLOCK}), 'text', substring(_text, outer.at + 1, greatest(0, array_max(transform(slice(_all, k * {BLOCK} + 1, {BLOCK}), x -> x.start)) - outer.at)))), b -> aggregate(b.own, named_struct('at', b.at, 'out', ''), (acc, x) -> {step}, acc -> named_struct('at', acc.at, 'outs', concat(outer.outs, array(acc.out)))))[0]"
    blocks = f"aggregate(sequence(0, (size(_all) - 1) div {BLOCK}), named_struct('at', 0, 'outs', cast(array() AS array<string>)), (outer, k) -> {block}, r -> concat(array_join(r.outs, ''), substring(_text, r.at + 1, length(_text))))"
    edited = f"CASE WHEN size(_all) = 0 THEN _text ELSE {blocks} END"
    return found.select("_row.*", F.expr(edited).alias(out))
