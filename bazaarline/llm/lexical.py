"""Ranked lexical search over shards of dual-sorted wavelet trees.

A shard has the postings of some documents as one sequence: term by term, each
term's documents by falling impact, so a prefix of a term's range is its best
documents. The wavelet tree over that sequence has the documents' numbers in the
shard as its values. Its nodes are ranges of document numbers, and every node
keeps the order by impact: the first posting that a term has in a node bounds what
the term can add to any document there, and the sum over a query's terms bounds
the node. The search opens the nodes with the highest bounds first, intersecting
the query's ranges on the way down; at the leaves, bounds are scores. It ends when no
open node reaches the least score that still counts, so the best ``k`` are exact.

Shards are built where the documents lie and never moved; only each task's best
``k`` of a query are. A query's terms are looked up in all shards first, which
gives their document frequencies. Queries are taken in blocks of ``BLOCK`` terms (a
query with more is a block of its own), each with one pass over the index.

Scores are those of BM25 in whole numbers; see :func:`impact` and :func:`weight`.

Defined cases: null and empty texts have no terms and are never found; rows of one
document id, repeated rows and rows without id are ranked each by itself, equal scores by
ascending id, null last; items of one id, null included, are one item with all
their terms; items without terms have no rows; an empty table gives none. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep
from .wavelet import Wavelet
from .words import WORDS, Shard, as_binary, shards

#: Most words and documents of a shard.
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 16
#: Terms of queries that are looked for together.
BLOCK = 1 << 16
#: Nodes that are opened together.
WIDTH = 512

_INDEX = "doc_ids array<bigint>, terms binary, starts binary, impacts binary, bits binary, levels int"


@dataclass(frozen=True)
class Index:
    """``rows`` is a written table with a row for each shard; ``docs`` counts the documents with a term."""

    rows: DataFrame
    docs: int


def impact(tf: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What an occurrence count adds in a document of ``length`` words, before the term's weight; at most a million."""
    m = 50 + (50 * length * docs) // max(words, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# ---- index -----------------------------------------------------------------


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = words = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(text.as_py().translate(WORDS).split())
            docs, words = docs + (n > 0), words + n
    yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "words": pa.array([words], pa.int64())})


def _postings(shard: Shard, docs: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, impacts and the start of each term's range."""
    terms, own = len(shard.terms), len(shard.rows)
    owner = np.repeat(np.arange(own, dtype=np.int64), shard.lengths)
    pairs, tf = np.unique(shard.words.astype(np.int64) * own + owner, return_counts=True)
    term, doc = pairs // own, pairs % own
    value = impact(tf.astype(np.int64), shard.lengths[doc], docs, words)
    order = np.lexsort((doc, -value, term))
    return doc[order], value[order].astype(np.int32), np.searchsorted(term, np.arange(terms + 1)).astype(np.int64)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> Index:
    """Index every row of ``docs``: two passes over the texts, none of which is moved."""
    rows = docs.select(as_binary(docs, text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"))
    sized = rows.select("_text").mapInArrow(_sizes, "docs long, words long")
    n = sized.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n_docs, n_words = n["docs"], n["words"]

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words, shard_docs):
            doc, value, starts = _postings(shard, n_docs, n_words)
            levels = max(len(shard.rows) - 1, 0).bit_length()
            row = {
                "doc_ids": pa.array([[r[0] for r in shard.rows]], pa.list_(pa.int64())),
                "terms": pa.array([b" ".join(shard.terms)], pa.binary()),
                "starts": pa.array([starts.tobytes()], pa.binary()),
                "impacts": pa.array([value.tobytes()], pa.binary()),
                "bits": pa.array([Wavelet.pack(doc, levels)], pa.binary()),
                "levels": pa.array([levels], pa.int32()),
            }
            yield pa.RecordBatch.from_pydict(row)

    return Index(keep(rows.mapInArrow(built, _INDEX), "lexical-index"), n_docs)


class _Tree:
    """A shard's row, ready for queries."""

    def __init__(self, row: dict):
        impacts = np.frombuffer(row["impacts"], np.int32)
        self.ids, self.starts = row["doc_ids"], np.frombuffer(row["starts"], np.int64)
        self.tree = Wavelet(row["bits"], row["levels"], len(impacts))
        self.impacts = self.tree.carried(impacts)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of documents among which are the ``k`` best that score ``least`` or more, ties included."""
        tree, last = self.tree, self.tree.levels
        # open nodes, and what they have of the query: one range for each of its terms that occurs there
        low, high, weigh, node = self.starts[terms], self.starts[terms + 1], weights, np.zeros(len(terms), np.int64)
        bound, level, prefix = np.array([int(np.dot(weights, self.impacts[0, low].astype(np.int64)))]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            ends = (level == last) & (bound >= least)
            if ends.any():
                scores, found = np.concatenate([scores, bound[ends]]), np.concatenate([found, prefix[ends]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    scores, found = scores[scores >= least], found[scores >= least]
            going = (level < last) & (bound >= least)
            if not going.any():
                return scores, found
            chosen = going if going.sum() <= WIDTH else going & (bound >= np.partition(bound[going], going.sum() - WIDTH)[going.sum() - WIDTH])
            kept = going & ~chosen
            opened, held = chosen[node], kept[node]
            number = np.cumsum(chosen) - 1
            lv, lo, hi = level[node[opened]], low[opened], high[opened]
            lo1, hi1 = tree.ones(lv, lo), tree.ones(lv, hi)
            z = tree.zeros[lv]
            low2, high2 = np.concatenate([lo - lo1, z + lo1]), np.concatenate([hi - hi1, z + hi1])
            weigh2, under = np.tile(weigh[opened], 2), np.tile(lv + 1, 2)
            node2 = np.concatenate([number[node[opened]] * 2, number[node[opened]] * 2 + 1])
            there = low2 < high2
            low2, high2, weigh2, node2, under = low2[there], high2[there], weigh2[there], node2[there], under[there]
            made = 2 * int(chosen.sum())
            bound2 = np.zeros(made, np.int64)
            np.add.at(bound2, node2, weigh2 * self.impacts[under, low2])
            level2, prefix2 = np.repeat(level[chosen] + 1, 2), np.repeat(prefix[chosen] * 2, 2) + np.tile([0, 1], made // 2)
            # nodes that stay open come first
            number = np.cumsum(kept) - 1
            low, high, weigh = np.concatenate([low[held], low2]), np.concatenate([high[held], high2]), np.concatenate([weigh[held], weigh2])
            node = np.concatenate([number[node[held]], int(kept.sum()) + node2])
            bound, level, prefix = np.concatenate([bound[kept], bound2]), np.concatenate([level[kept], level2]), np.concatenate([prefix[kept], prefix2])


# ---- search ----------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, text in enumerate(batch.column("_text")):
            found = list(set(text.as_py().translate(WORDS).split()))
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("item_id")[k], len(found)), pa.array(found, pa.binary())], ["item_id", "term"])


def _best(ids: list, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: highest score, then least id, null last."""
    known = np.array([i is not None for i in ids], bool)
    number = np.array([i or 0 for i in ids], np.int64)
    return np.lexsort((number, ~known, -scores))[:k]


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item that score above 0."""
    id_type = items.schema[id_col].dataType.simpleString()
    queries = items.select(F.col(id_col).alias("item_id"), as_binary(items, text_col).alias("_text"))
    terms = keep(queries.mapInArrow(_item_terms, f"item_id {id_type}, term binary").distinct(), "lexical-queries")
    blocks = max(1, math.ceil(terms.count() / BLOCK))
    out = None
    for b in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else terms
        found = _search_block(index, asked, k, id_type)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """(item_id, doc_id, score): of each task the best ``k`` of each item. A block's terms are bounded, so tasks get them whole."""
    by_item: dict = {}
    for r in asked.toArrow().to_pylist():
        by_item.setdefault(r["item_id"], []).append(r["term"])
    wanted = {t for ts in by_item.values() for t in ts}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.diff(np.frombuffer(row["starts"], np.int64))
                there = [(t, int(sizes[n])) for n, t in enumerate(row["terms"].split()) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in there], pa.binary()), pa.array([n for _, n in there], pa.int64())], ["term", "n"])

    counted = index.rows.select("terms", "starts").mapInArrow(frequencies, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weights = {r["term"]: weight(r["df"], index.docs) for r in counted.toArrow().to_pylist()}
    weights = {t: w for t, w in weights.items() if w > 0}
    queries = [(i, [t for t in ts if t in weights]) for i, ts in by_item.items()]
    queries = [(i, ts) for i, ts in queries if ts]
    item_type = asked.schema["item_id"].dataType

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best: list = [([], np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Tree(row)
                number = {t: n for n, t in enumerate(row["terms"].split()) if t in weights}
                for q, (_, ts) in enumerate(queries):
                    own = [t for t in ts if t in number]
                    if not own:
                        continue
                    ids, scores = best[q]
                    least = int(scores[-1]) if len(scores) == k else 1
                    more, docs = shard.best(np.array([number[t] for t in own]), np.array([weights[t] for t in own], np.int64), k, least)
                    if len(more):
                        ids, scores = ids + [shard.ids[d] for d in docs], np.concatenate([scores, more])
                        first = _best(ids, scores, k)
                        best[q] = [ids[p] for p in first], scores[first]
        counts = [len(ids) for ids, _ in best]
        arrays = [
            pa.array([i for (i, _), n in zip(queries, counts, strict=True) for _ in range(n)], to_arrow_type(item_type)),
            pa.array([i for ids, _ in best for i in ids], pa.int64()),
            pa.array(np.concatenate([s for _, s in best]) if best else [], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "score"])

    return index.rows.mapInArrow(searched, f"item_id {id_type}, doc_id long, score long")
