"""How the sources of each language differ in their words, exactly.

Two passes over the texts. The first counts in how many documents of a language each
term occurs, and keeps those that occur in ``LEAST`` or more. The second counts the
occurrences of kept terms: an Aho-Corasick automaton of a slice of the vocabulary,
each term between two spaces, runs over texts whose other characters are all
spaces. A slice has at most about ``SLICE`` terms, and only documents of its languages are
read for it; small languages share a slice.

A source's share of a term is ``1 + floor(SCALE * (count + 1) / (N + V))``, and what
sets two shares p and q apart ``floor((p - q)^2 / q)``. Counts are sparse: a pair of
sources is compared by the terms that both have, one row of sources for each term,
and by how many terms a source has with each count; terms that neither has are the
same for all of them. So nothing is written for a term that a source lacks.

Defined cases: null text, language and source count as empty; a source without
terms takes part with no counts; where no term is kept every pair has the value 0;
repeated rows count each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep
from .words import LETTERS, as_binary

#: Documents that a kept term is in; whole of the shares; reported terms of a source.
LEAST, SCALE, TERMS = 3, 1_000_000_000, 200
#: Terms of an automaton, and different terms that a task counts before it hands its counts on.
SLICE, HELD = 1 << 20, 1 << 20


def _grouped(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(as_binary(docs, text_col).alias("_text"), named(lang_col).alias("lang"), named(source_col).alias("source"))


# ---- vocabulary ------------------------------------------------------------


def _terms_by_lang(counted: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counted.items():
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["lang", "term", "n"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: dict = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column("_text"), batch.column("lang").to_pylist(), strict=True):
            counted[lang].update(set(text.as_py().translate(LETTERS).split()))
            if sum(map(len, counted.values())) > HELD:
                yield from _terms_by_lang(counted)
                counted.clear()
    yield from _terms_by_lang(counted)


def vocabulary(rows: DataFrame) -> DataFrame:
    """(lang, term, id): the terms in ``LEAST`` documents of a language or more, numbered, as a written table."""
    counted = rows.select("_text", "lang").mapInArrow(_document_counts, "lang string, term binary, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return keep(kept.select("lang", "term", F.monotonically_increasing_id().alias("id")), "vocabulary")


# ---- occurrences -----------------------------------------------------------

_AUTOMATA: dict[str, dict[str, ahocorasick.Automaton]] = {}


def _automata(name: str, terms: dict[str, tuple[bytes, list[int]]]) -> dict[str, ahocorasick.Automaton]:
    """One for each language of a slice. The last ones made stay with the worker, whose next task mostly needs them again."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        made = {}
        for lang, (joined, ids) in terms.items():
            made[lang] = ahocorasick.Automaton()
            for t, number in zip(joined.decode("latin-1").split(" "), ids, strict=True):
                made[lang].add_word(f" {t} ", number)  # bytes as characters: the table works on bytes
            made[lang].make_automaton()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def _recount(rows: DataFrame, own: DataFrame) -> DataFrame:
    """(id, source, n): how often a slice's terms occur in the documents of their languages."""
    terms: dict = defaultdict(lambda: ([], []))
    for r in own.toArrow().to_pylist():
        terms[r["lang"]][0].append(r["term"])
        terms[r["lang"]][1].append(r["id"])
    name, sent = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast({lang: (b" ".join(ts), ids) for lang, (ts, ids) in terms.items()})  # at most a slice

    def by_source(counted: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for source, own in counted.items():
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int64()), pa.repeat(pa.scalar(source, pa.string()), len(own)), pa.array(own.values(), pa.int64())], ["id", "source", "n"])

    def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counted, held = _automata(name, sent.value), defaultdict(Counter), 0
        for batch in batches:
            for text, lang, source in zip(batch.column("_text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                own = counted[source]
                held -= len(own)
                own.update(map(itemgetter(1), made[lang].iter(f" {text.as_py().translate(LETTERS).decode('latin-1')} ")))
                held += len(own)
                if held > HELD:
                    yield from by_source(counted)
                    counted.clear()
                    held = 0
        yield from by_source(counted)

    return rows.where(F.col("lang").isin(list(terms))).mapInArrow(recounted, "id long, source string, n long")


def _slices(vocab: DataFrame) -> Iterator[DataFrame]:
    """Parts of the vocabulary: small languages together, large ones in several by a hash of the term. Languages are counted on the driver."""
    sizes = {r["lang"]: r["n"] for r in vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    together: list[str] = []
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        if n > SLICE:
            parts = math.ceil(n / SLICE)
            for p in range(parts):
                yield vocab.where((F.col("lang") == lang) & (F.pmod(F.xxhash64("term"), F.lit(parts)) == p))
        elif together and sum(sizes[x] for x in together) + n > SLICE:
            yield vocab.where(F.col("lang").isin(together))
            together = [lang]
        else:
            together.append(lang)
    if together:
        yield vocab.where(F.col("lang").isin(together))


def postings(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, term, has): for each kept term that occurs the sources that have it and how often, as a written table.

    Tasks hand on sums, so no term has more rows than tasks and sources make of it.
    """
    out = rows.sparkSession.createDataFrame([], "id long, source string, n long")
    for own in _slices(vocab):
        out = out.unionByName(_recount(rows, own))
    # dealt by term once: sums by source, their lists and the term's text follow without another shuffle of counts
    summed = out.repartition("id").groupBy("id", "source").agg(F.sum("n").alias("n"))
    lists = summed.groupBy("id").agg(F.collect_list(F.struct("source", "n")).alias("has"))
    return keep(lists.join(vocab.hint("shuffle_hash"), "id").select("lang", "term", "has"), "postings")


# ---- shares and what sets them apart ---------------------------------------


def share(count: Column, total: Column, terms: Column) -> Column:
    whole, wide = total + terms, count.cast("decimal(19,0)") + 1
    most = (1 << 63) // SCALE - 2  # counts up to here stay within 64 bits
    return 1 + F.when(count <= most, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), whole)).otherwise(F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide, whole.cast("decimal(19,0)")))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pairs(posted: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other one of its language.

    Over all V terms of a language, with p0 and q0 for a term that a source lacks:
    V f(p0, q0), plus for the terms of the first f(p, q0) - f(p0, q0), plus for
    those of the second f(p0, q) - f(p0, q0), plus for those of both
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). A source's shares add up to SCALE + V, so
    no sum is over (SCALE + V) squared, and 64 bits hold them up to a billion terms.
    """
    c = F.col
    one, two = (groups.select("lang", c("source").alias(s), c("total").alias(f"N{k}"), "V", c("p0").alias(f"p{k}")) for k, s in ((1, "source"), (2, "item")))
    both = one.join(two.drop("V"), "lang").where("source <> item").withColumn("f0", apart(c("p1"), c("p2")))
    # how many of a source's terms occur so often
    spread = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    mine = both.join(spread, ["lang", "source"]).withColumn("x", c("terms") * (apart(share(c("n"), c("N1"), c("V")), c("p2")) - c("f0")))
    theirs = both.join(spread.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("x", c("terms") * (apart(c("p1"), share(c("n"), c("N2"), c("V"))) - c("f0")))
    # the sources of each term that several have
    known = groups.groupBy("lang").agg(F.first("V").alias("V"), F.map_from_entries(F.collect_list(F.struct("source", F.struct("total", "p0")))).alias("of"))
    held = posted.where(F.size("has") > 1).join(known, "lang")
    shares = F.transform("has", lambda x: F.struct(x["source"].alias("source"), share(x["n"], c("of")[x["source"]]["total"], c("V")).alias("p"), c("of")[x["source"]]["p0"].alias("p0")))
    # both directions of two sources at once
    met = held.select("lang", F.array_sort(shares).alias("has")).select("lang", "has", F.posexplode("has").alias("k", "a")).select("lang", "a", F.explode(F.expr("slice(has, k + 2, size(has))")).alias("b"))
    a, b, a0, b0 = c("a.p"), c("b.p"), c("a.p0"), c("b.p0")
    more = lambda a, b, a0, b0: F.sum(apart(a, b) - apart(a, b0) - apart(a0, b) + apart(a0, b0))
    summed = met.groupBy("lang", c("a.source").alias("source"), c("b.source").alias("item")).agg(more(a, b, a0, b0).alias("x"), more(b, a, b0, a0).alias("y"))
    ways = F.array(F.struct("source", "item", "x"), F.struct(c("item").alias("source"), c("source").alias("item"), c("y").alias("x")))
    shared = summed.select("lang", F.inline(ways))
    parts = [d.select("lang", "source", "item", "x") for d in (both.withColumn("x", c("V") * c("f0")), mine, theirs, shared)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))


def terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source uses more than its language does."""
    c = F.col
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = counts.join(groups, ["lang", "source"]).join(langs, "lang")
    rows = rows.withColumn("p", share(c("n"), c("total"), c("V"))).withColumn("q", share(c("in_lang"), c("lang_total"), c("V"))).where("p > q")
    return rows.select("lang", "source", c("term").cast("string").alias("item"), apart(c("p"), c("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language (``pair``) and the ``TERMS`` first terms (``term``)."""
    rows = _grouped(docs, text_col, lang_col, source_col)
    vocab = vocabulary(rows)
    posted = postings(rows, vocab)
    in_lang = F.aggregate("has", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    counts = posted.withColumn("in_lang", in_lang).select("lang", "term", "in_lang", F.inline("has"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("V"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "V"])
    groups = keep(groups.withColumn("p0", F.when(F.col("V") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("V"))).otherwise(F.lit(1))), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs(posted, counts, groups), "pair").unionByName(ranked(terms(counts, groups), "term").where(F.col("rank") <= TERMS))
