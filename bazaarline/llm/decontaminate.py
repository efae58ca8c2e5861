"""Benchmark passages in training documents, found in an FM-index of each shard of documents.

A shard is the words of some documents as one sequence of numbers. Its suffixes
are sorted whole, by doubling over those still alike; the words before them (the
Burrows-Wheeler transform) are a wavelet tree. A phrase is searched from its last word
backwards, two ranks a word, for all phrases of a block at once. What is left of
a phrase's range are its occurrences; each is followed back, again by ranks, to the
nearest suffix whose position is kept: one in ``SAMPLE`` and each document's first.

A phrase is a window of ``WINDOW`` consecutive words of an item; an item of fewer
words is one phrase. Documents longer than ``SHARD_WORDS`` are cut into pieces that
overlap by ``WINDOW - 1`` words, so no occurrence is lost; spans of pieces and of
blocks of phrases are merged. Documents never leave the task that reads them.

Defined cases: null and empty texts have no words, so no hits; every input row gets a
row, repeated rows and rows without id too; items of one id are one item,
null counts as an id of its own that is written as nothing; items without words are
never found; empty tables give no rows or no hits. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep
from .wavelet import Wavelet
from .words import WORDS, as_binary, shards, task_numbers

#: Words of a phrase.
WINDOW = 10
#: Most words and documents of a shard; one in so many suffix positions is kept.
SHARD_WORDS, SHARD_DOCS, SAMPLE = 1 << 20, 1 << 16, 8
#: Phrases that are searched together.
BLOCK = 1 << 16
_BITS = 21

_SHARD = "rows array<bigint>, offsets array<bigint>, ids array<bigint>, digests array<bigint>, starts array<bigint>, lengths array<bigint>, terms binary, bits binary, levels int, sampled binary, positions binary, firsts binary"


@dataclass(frozen=True)
class Index:
    """``shards`` is a written table; ``docs`` (_row, _id, _digest, n_words) has a row for each input row."""

    shards: DataFrame
    docs: DataFrame


# ---- index -----------------------------------------------------------------


def suffixes(ranks: np.ndarray, most: int) -> np.ndarray:
    """Positions of the suffixes of ``ranks`` (0 to ``most``) in their order; the last value must be unique.

    The first sort takes three values at once; each later one looks twice as far and
    only sorts suffixes that are still alike.
    """
    n = len(ranks)
    if most < 1 << _BITS:
        key, far = np.zeros(n, np.int64), min(3, n)
        for k in range(far):
            key <<= _BITS
            key[: n - k] |= ranks[k:]
    else:
        key, far = ranks.astype(np.int64), 1
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
    while len(open_):
        own = order[open_]
        ahead = np.minimum(own + far, n - 1)
        key = rank[own] << 32 | rank[ahead]
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        rank[own] = np.repeat(open_[first], np.diff(np.append(first, len(own))))
        open_ = open_[~(new & np.append(new[1:], True))]
        far *= 2
    return order


def _packed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, terms: int) -> dict[str, bytes | int]:
    """The FM-index of documents that follow each other in ``words``. Number 0 ends a document, words are from 1 on."""
    docs, n = len(starts), len(words) + len(starts)
    ends = starts + lengths + np.arange(docs)
    text = np.zeros(n, np.int64)
    mask = np.ones(n, bool)
    mask[ends] = False
    text[mask] = words.astype(np.int64) + 1
    ranks = text + docs - 1
    ranks[ends] = np.arange(docs)  # each end is less than all words and unlike other ends
    order = suffixes(ranks, docs + terms)
    before = text[order - 1]
    begins = np.zeros(n, bool)
    begins[starts + np.arange(docs)] = True
    sampled = (order % SAMPLE == 0) | begins[order]
    levels = int(terms).bit_length()
    firsts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=terms + 1))]).astype(np.int32)
    return {"bits": Wavelet.pack(before, levels), "levels": levels, "sampled": Wavelet.pack(sampled.astype(np.int64), 1), "positions": order[sampled].astype(np.int32).tobytes(), "firsts": firsts.tobytes()}


def _pieces(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, row, offset, id, digest): a document of more than ``most_words`` words in overlapping pieces."""
    rows, step = task_numbers(), most_words - WINDOW + 1
    for batch in batches:
        texts, owners, offsets, took = [], [], [], []
        for k, text in enumerate(batch.column(0)):
            text, cuts = text.as_py().translate(WORDS), [0]
            if len(text) // 2 >= most_words:  # it can have as many words
                found = text.split()
                cuts = list(range(0, max(1, len(found) - WINDOW + 1), step))
                texts += [b" ".join(found[at : at + most_words]) for at in cuts]
            else:
                texts.append(text)
            owners += [next(rows)] * len(cuts)
            offsets += cuts
            took += [k] * len(cuts)
        took = pa.array(took, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(owners, pa.int64()), pa.array(offsets, pa.int64()), batch.column(1).take(took), batch.column(2).take(took)], ["text", "row", "offset", "id", "digest"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> Index:
    """Index every row of ``docs`` in one pass over the texts."""
    text = as_binary(docs, text_col)
    rows = docs.select(text.alias("_text"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_digest"))
    longs = pa.list_(pa.int64())
    schema = pa.schema([*((k, longs) for k in ("rows", "offsets", "ids", "digests", "starts", "lengths")), *((k, pa.binary()) for k in ("terms", "bits")), ("levels", pa.int32()), *((k, pa.binary()) for k in ("sampled", "positions", "firsts"))])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(_pieces(batches, shard_words), shard_words, shard_docs):
            row = dict(zip(("rows", "offsets", "ids", "digests"), map(list, zip(*shard.rows, strict=True)), strict=True))
            row |= {"starts": shard.starts.tolist(), "lengths": shard.lengths.tolist(), "terms": b" ".join(shard.terms)}
            yield pa.RecordBatch.from_pylist([row | _packed(shard.words, shard.starts, shard.lengths, len(shard.terms))], schema)

    table = keep(rows.mapInArrow(built, _SHARD), "fm-index")
    pieces = table.select(F.inline(F.arrays_zip("rows", "ids", "digests", "offsets", "lengths")))
    # a document's words end where its last piece does
    held = pieces.groupBy(F.col("rows").alias("_row")).agg(F.max("ids").alias("_id"), F.max("digests").alias("_digest"), F.max(F.col("offsets") + F.col("lengths")).alias("n_words"))
    return Index(table.drop("ids", "digests", "lengths"), held)


class _Searcher:
    """A shard's row, ready for phrases."""

    def __init__(self, row: dict):
        self.firsts = np.frombuffer(row["firsts"], np.int32).astype(np.int64)
        self.size = int(self.firsts[-1])
        self.tree, self.marks = Wavelet(row["bits"], row["levels"], self.size), Wavelet(row["sampled"], 1, self.size)
        self.positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        # documents begin so many ends further
        self.starts = np.array(row["starts"], np.int64) + np.arange(len(row["starts"]))

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length, as rows of word numbers, the range of suffixes that begin with each; empty if none does."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        left = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[left, k]
            lo, hi = self.firsts[word] + self.tree.rank(word, low[left]), self.firsts[word] + self.tree.rank(word, high[left])
            low[left], high[left] = lo, hi
            left = left[lo < hi]
            if not len(left):
                break
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Where in the text the suffixes of these places begin."""
        out, steps = np.empty(len(places), np.int64), np.zeros(len(places), np.int64)
        left, at = np.arange(len(places)), places
        while len(left):
            here = self.marks.bit(0, at) == 1
            out[left[here]] = self.positions[self.marks.ones(0, at[here])] + steps[left[here]]
            left, at = left[~here], at[~here]
            if len(left):
                word, rank = self.tree.access(at)
                at = self.firsts[word] + rank
                steps[left] += 1
        return out


# ---- phrases ---------------------------------------------------------------


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, phrase): the different windows of each item, its words with one space between them."""
    id_type = items.schema[id_col].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("_text")):
                words = text.as_py().translate(WORDS).split()
                found = list({b" ".join(words[a : a + window]) for a in range(max(1, len(words) - window + 1))} - {b""})
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("item_id")[k], len(found)), pa.array(found, pa.binary())], ["item_id", "phrase"])

    rows = items.select(F.col(id_col).alias("item_id"), as_binary(items, text_col).alias("_text"))
    return rows.mapInArrow(windows, f"item_id {id_type}, phrase binary").distinct()


def _hits(index: Index, block: list[bytes]) -> DataFrame:
    """(_row, phrase, start, end): occurrences of a block's phrases, in words of the document, end exclusive."""
    split = [p.split() for p in block]
    known = {w for ws in split for w in ws}
    by_length: dict[int, list[int]] = {}
    for k, ws in enumerate(split):
        by_length.setdefault(len(ws), []).append(k)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                number = {t: k for k, t in enumerate(row["terms"].split(), 1) if t in known}
                shard, found = None, []
                for n, own in by_length.items():
                    there = [k for k in own if all(w in number for w in split[k])]
                    if not there:
                        continue
                    shard = shard or _Searcher(row)
                    low, high = shard.ranges(np.array([[number[w] for w in split[k]] for k in there], np.int64))
                    times = np.maximum(high - low, 0)
                    which = np.repeat(np.arange(len(there)), times)
                    at = shard.locate(np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which])
                    found.append((np.array(there, np.int64)[which], at, np.full(len(at), n)))
                if not found:
                    continue
                phrase, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = np.searchsorted(shard.starts, at, side="right") - 1
                start = at - shard.starts[doc] + np.array(row["offsets"], np.int64)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(row["rows"], np.int64)[doc]), pa.array(block, pa.binary()).take(pa.array(phrase)), pa.array(start), pa.array(start + n)], ["_row", "phrase", "start", "end"])

    return index.shards.mapInArrow(searched, "_row long, phrase binary, start long, end long")


def occurrences(index: Index, asked: DataFrame) -> DataFrame:
    """(_row, phrase, start, end) for the ``phrase`` column of ``asked``, a written table: blocks of phrases against all shards."""
    distinct = keep(asked.select("phrase").distinct(), "fm-phrases")
    blocks = max(1, math.ceil(distinct.count() / BLOCK))
    out = None
    for b in range(blocks):
        block = sorted(r["phrase"] for r in distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).toArrow().to_pylist())
        hits = _hits(index, block)
        out = hits if out is None else out.unionByName(hits)
    return keep(out, "fm-hits")


# ---- results ---------------------------------------------------------------


def merged_spans(hits: DataFrame) -> DataFrame:
    """(_row, start, end): occurrences of a document that touch or overlap, as one span to remove."""
    order = Window.partitionBy("_row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("_row", "start", "end").distinct().withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("long"))
    return begun.withColumn("_span", F.sum("_new").over(order)).groupBy("_row", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_span")


def _written(item: Column) -> Column:
    return F.coalesce(item.cast("string"), F.lit(""))


def _spans(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All occurrences, and (_row, n_hit, spans) of the documents that have any."""
    hits = occurrences(index, asked)
    spans = merged_spans(hits).groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return hits, spans


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shards: int) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, the sorted ids of items as text, spans to remove (in words, end exclusive)."""
    index = build(docs, id_col, text_col, **shards)
    asked = keep(phrases(items), "fm-items")
    hits, spans = _spans(index, asked)
    named = hits.select("_row", "phrase").distinct().join(asked, "phrase").select("_row", _written(F.col("item_id")).alias("item")).distinct()
    found = named.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = index.docs.join(spans.join(found, "_row"), "_row", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of all spans, and what stands between them, cut out of the texts; other columns and rows as they are."""
    index = build(docs, id_col, text_col)
    _, spans = _spans(index, keep(phrases(items), "fm-items"))
    cut = spans.join(index.docs, "_row").groupBy("_id", "_digest").agg(F.first("spans").alias("_spans"))  # rows of one id and text have the same spans

    def without(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if own:
                raw, kept, last = t.encode(), [], 0
                words = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
                for s in own:
                    kept.append(raw[last : words[s["start"]][0]])
                    last = words[s["end"] - 1][1]
                t = b"".join([*kept, raw[last:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    cleaned = F.arrow_udf(without, "string")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(id_col).cast("long").alias("_own"), F.xxhash64(as_binary(docs, text_col)).alias("_text_digest"))
    joined = keyed.join(cut, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_digest") == F.col("_digest")), "left")
    return joined.select(*[cleaned(F.col(f"_doc.{c}").cast("string"), F.col("_spans")).alias(c) if c == text_col else F.col(f"_doc.{c}").alias(c) for c in docs.columns])
