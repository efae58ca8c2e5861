"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``distance`` bits are linked; a component is what links
reach. Documents are first reduced to distinct fingerprints, so copies cost
nothing further. Fingerprints are arranged with some block of their bits in
front and sorted by Gray rank, so that equal fronts lie together and neighbours
share long bit patterns. The sorted run is cut into leaves, each with the mask of
the bits all its members share; leaves form upper nodes in the same way. Two
nodes whose shared bits already differ in more than ``distance`` places are
pruned with all below them.

With one word of 64 bits the search is exact: of ``b`` blocks of its bits,
fingerprints within ``distance`` bits agree in ``b - distance``, and every choice
of so many blocks is a front. More fingerprints take more blocks, so that fronts
get longer and their members stay few. Texts alike to 0.8 by their shingles differ
in about ten of 64 bits, beyond what any such front can catch, so for
:func:`drop_alike` fingerprints have several words, from as many hashes of each
distinct shingle, all their blocks serve as fronts, and the bit limit is loose;
:func:`wide_shape` says how many of what width. That only finds candidates. Every
two texts of a candidate component are then compared by their whole sets of
shingles, and components are made of the pairs that are alike to 0.8.

A front's members that lie in one leaf are linked where the sort put them. A hot
front fills many leaves, over many tasks; its surviving pairs of leaves are dealt
out as work of equal size. A leaf or a pair gives a spanning forest of its links,
never all pairs, and components come from star contraction over written tables.

Defined cases: null text counts as empty, and texts without words have
fingerprint zero, linked like any other; repeated rows get a row each; a null id
never names a component unless all its ids are null; where rows are dropped, each component keeps one, whatever its id; an empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import filtered
from .storage import drop, keep, kept

SHINGLE = 3
DISTANCE = 3
#: Members of a front that longer fronts are taken for on average.
CROWDED = 64
#: To find candidates for texts alike to 0.8: words of a shingle, least words of a fingerprint, least bits of a front, differing bits of a word allowed.
WIDE_SHINGLE, WIDE_WORDS, WIDE_BAND, WIDE_DISTANCE = 5, 8, 12, 15
#: Texts, as a power of two, up to which fronts have the least width; most width; share of equal bits and of missed pairs at 0.8 that shapes are made for.
WIDE_TEXTS, WIDE_MOST, WIDE_EQUAL, WIDE_MISSED = 24, 20, 0.84, 0.01
#: Likeness of two sets of shingles, as a fraction.
ALIKE = (4, 5)
#: About so many texts of a candidate component in a block; two blocks are compared together.
BLOCK = 128
SEED = 42
#: Fingerprints in a leaf, members of a node inside it, leaves in an upper node.
LEAF, NODE, UPPER = 512, 16, 32
#: Fronts of up to so many members are compared together.
TOGETHER = 48
_BITS = 64
#: Stands for a null id, so that it never names a component.
_NO_ID = (1 << 63) - 1


def _rehashed(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hash itself, then further ones mixed from it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _digests(text: str, shingle: int, step: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, ``step`` at a time; fewer words than ``shingle`` are one shingle."""
    found = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + step], stops[at : at + step], strict=True)], np.uint64)


def shingles(text: str, shingle: int) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes of 64 bits."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_digests(text, shingle, 1 << 16)]))


def fingerprint(text: str, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """The signed 64-bit words of a whole text's fingerprint; with several words a repeated shingle counts once."""
    step = 8192 // words
    if words > 1:
        every = shingles(text, shingle)
        parts: Iterable[np.ndarray] = (every[at : at + step] for at in range(0, len(every), step))
    else:
        parts = _digests(text, shingle, step)
    counts, n = np.zeros(_BITS * words, np.int64), 0
    for h in parts:
        bits = np.unpackbits(_rehashed(h, words).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
        n += len(h)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.int64).tolist()


def _text_key(text_col: str) -> Column:
    """Digest of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, keyed: bool = False) -> DataFrame:
    """(_id, _fp) per row, with ``keyed`` also the text's digest ``_key``; ``_fp`` is an array of ``words`` longs."""
    names = ["_id", "_key"] if keyed else ["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, words) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps, pa.list_(pa.int64()))], [*names, "_fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    own = docs.select(F.col(id_col).cast("long").alias("_id"), *([_text_key(text_col).alias("_key")] if keyed else []), text)
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", _fp array<long>")


# ---- the index -------------------------------------------------------------


def wide_shape(n: int) -> tuple[int, int]:
    """(words, band) for ``n`` texts: each doubling beyond ``2**WIDE_TEXTS`` makes fronts a bit longer, and so many more of them that as few pairs are missed."""
    band = min(WIDE_MOST, WIDE_BAND + max(0, math.ceil(math.log2(max(1, n))) - WIDE_TEXTS))
    fronts = math.log(WIDE_MISSED) / math.log(1 - WIDE_EQUAL**band)
    return max(WIDE_WORDS, math.ceil(fronts / (_BITS // band))), band


def front_blocks(n: int, distance: int) -> int:
    """Blocks of a 64-bit word for an exact search among ``n`` fingerprints: the fewest whose fronts aren't crowded, and two more than the least at most."""
    least = distance + 1
    return next((b for b in range(least, least + 2) if n <= CROWDED << (b - distance) * _BITS // b), least + 2)


def _arrangements(words: int, distance: int, band: int | None, blocks: int) -> list[tuple[int, list[tuple[int, int]], int]]:
    """(word, its bit ranges in their new order, width of the front) of each arrangement.

    Without ``band`` one word is cut into ``blocks``, and the search is exact.
    """
    if band is None and words > 1:
        raise ValueError("an exact search takes one word")
    blocks, equal = (blocks, blocks - distance) if band is None else (_BITS // band, 1)
    edges = [round(_BITS * k / blocks) for k in range(blocks + 1)]
    ranges = list(zip(edges, edges[1:], strict=False))
    return [(w, [*front, *(x for x in ranges if x not in front)], sum(high - low for low, high in front)) for w in range(words) for front in combinations(ranges, equal)]


def _arranged(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` in another order; the first range ends up on top."""
    out, top = F.lit(0).cast("long"), _BITS
    for low, high in order:
        width = high - low
        part = F.shiftrightunsigned(fp, low)
        part = part if width == _BITS else part.bitwiseAND(F.lit((1 << width) - 1))
        top -= width
        out = out.bitwiseOR(F.shiftleft(part, top))
    return out


def _with_gray_rank(df: DataFrame, x: str) -> DataFrame:
    """Replaces ``x`` by its place in Gray order: each bit becomes the parity of the bits above it and itself."""
    for step in (1, 2, 4, 8, 16, 32):  # a column each, as one expression would double with every step
        df = df.withColumn(x, F.col(x).bitwiseXOR(F.shiftrightunsigned(x, step)))
    return df.withColumn(x, F.col(x).bitwiseXOR(F.lit(-(1 << 63))))  # so that signed order is unsigned order


def _shared(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the bits that all of a node share, their pattern); members of a node are on the last axis but one."""
    both, any_ = np.bitwise_and.reduce(members, axis=-2), np.bitwise_or.reduce(members, axis=-2)
    mask = ~(both ^ any_)
    return mask, both & mask


def _apart(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int32)  # of signed numbers it counts the magnitude's bits


def _near_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the near pairs between two Gray-ordered runs of (n, words), node by node."""
    if len(a) * len(b) <= 4 * NODE * NODE:
        return np.nonzero(_apart(a[:, None] ^ b[None, :]) <= distance)
    runs = []
    for run in (a, b):
        idx = np.minimum(np.arange(-(-len(run) // NODE) * NODE), len(run) - 1).reshape(-1, NODE)
        runs.append((idx, run[idx], *_shared(run[idx])))
    (ia, va, ma, pa_), (ib, vb, mb, pb) = runs
    na, nb = np.nonzero(_apart((pa_[:, None] ^ pb[None, :]) & ma[:, None] & mb[None, :]) <= distance)
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(na), 512):
        x, y = na[at : at + 512], nb[at : at + 512]
        k, i, j = np.nonzero(_apart(va[x][:, :, None] ^ vb[y][:, None, :]) <= distance)
        found_i.append(ia[x[k], i])
        found_j.append(ib[y[k], j])
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes that the links reach; a root is the first of its tree."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.nonzero(label != np.arange(n))[0]
    return node, label[node]


def _links(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, root) within one leaf or between two; column 0 of a leaf has the nodes, the others the words."""
    if b is None:
        i, j = _near_pairs(a[:, 1:], a[:, 1:], distance)
        every = a[:, 0]
    else:
        i, j = _near_pairs(a[:, 1:], b[:, 1:], distance)
        every, j = np.concatenate([a[:, 0], b[:, 0]]), j + len(a)
    apart = i < j
    if not apart.any():
        return every[:0], every[:0]
    node, root = _forest(len(every), i[apart], j[apart])
    return every[node], every[root]


def _links_together(rows: np.ndarray, starts: np.ndarray, size: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of many groups of ``size`` consecutive rows."""
    step = max(1, (1 << 20) // (size * size * (rows.shape[1] - 1)))
    for at in range(0, len(starts), step):
        groups = rows[starts[at : at + step, None] + np.arange(size)]
        near = _apart(groups[:, :, None, 1:] ^ groups[:, None, :, 1:]) <= distance
        near &= np.triu(np.ones((size, size), bool), 1)
        for k in np.nonzero(near.any((1, 2)))[0].tolist():
            node, root = _forest(size, *np.nonzero(near[k]))
            yield groups[k, node, 0], groups[k, root, 0]


_FOUND = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("arrangement", pa.int32()), ("front", pa.int64()), ("leaf", pa.int64()), ("upper", pa.int64()), ("mask", pa.list_(pa.int64())), ("pattern", pa.list_(pa.int64())), ("members", pa.binary())]
)
_FOUND_DDL = "a long, b long, arrangement int, front long, leaf long, upper long, mask array<long>, pattern array<long>, members binary"


def _cut_leaves(batches: Iterator[pa.RecordBatch], words: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Sorted (arrangement, front, node, fp) to links of fronts in one leaf, and leaves of all other fronts."""
    task, count = TaskContext.get().partitionId() << 36, 0
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    leaves: list[dict] = []
    none = np.empty((0, 1 + words), np.int64)
    front, run, first_front, parts = None, none, True, 0

    def emit(ended: bool) -> None:
        """The run is one leaf: link it if its front surely lies in it alone."""
        nonlocal count, parts
        if not len(run):
            return
        if ended and not parts and not first_front:
            if len(run) > 1:
                edges.append(_links(run, None, distance))
            return
        mask, pattern = (x[1:].tolist() for x in _shared(run))
        leaves.append({"arrangement": front[0], "front": front[1], "leaf": task + count, "upper": task + count // UPPER, "mask": mask, "pattern": pattern, "members": run.tobytes()})
        count, parts = count + 1, parts + 1

    def out(last: bool = False) -> Iterator[pa.RecordBatch]:
        if last or sum(len(e[0]) for e in edges) + len(leaves) > 4096:
            if edges:
                a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
                empty = [pa.nulls(len(a), f.type) for f in list(_FOUND)[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=_FOUND)
                edges.clear()
            if leaves:
                yield pa.RecordBatch.from_pylist(leaves, schema=_FOUND)
                leaves.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        arr, fronts, nodes = (batch.column(c).to_numpy() for c in ("_arrangement", "_front", "_node"))
        rows = np.column_stack([nodes, batch.column("_fp").flatten().to_numpy().reshape(-1, words)])
        cuts = np.nonzero((arr[1:] != arr[:-1]) | (fronts[1:] != fronts[:-1]))[0] + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
        # fronts that begin and end within the batch are small and many: all of a size go together
        inner_starts, sizes = starts[1:-1], (stops - starts)[1:-1]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= TOGETHER)]).tolist():
            edges.extend(_links_together(rows, inner_starts[sizes == size], size, distance))
        large = (np.nonzero(sizes > TOGETHER)[0] + 1).tolist()
        for k in dict.fromkeys([0, *large, len(starts) - 1]):
            low, high = int(starts[k]), int(stops[k])
            here = (int(arr[low]), int(fronts[low]))
            if front is not None and here != front:
                emit(True)
                run, parts, first_front = none, 0, False
            front = here
            run = np.concatenate([run, rows[low:high]])
            while len(run) > LEAF:  # more of this front is known to follow
                rest, run = run[LEAF:], run[:LEAF]
                emit(False)
                run = rest
        yield from out()
    if front is not None:
        emit(False)  # the next task may hold more of the last front
    yield from out(last=True)


def links(fps: DataFrame, words: int = 1, distance: int = DISTANCE, band: int | None = None, blocks: int | None = None) -> DataFrame:
    """(a, b): a spanning set of links between the nodes of (_node, _fp), a written table."""
    ways = []
    for k, (word, order, width) in enumerate(_arrangements(words, distance, band, blocks or front_blocks(fps.count(), distance))):
        x = _arranged(F.col("_fp")[word], order)
        ways.append(F.struct(F.lit(k).alias("_arrangement"), F.shiftrightunsigned(x, _BITS - width).alias("_front"), x.alias("_rank")))
    placed = _with_gray_rank(fps.select("_node", "_fp", F.inline(F.array(*ways))), "_rank")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work grows faster than the bytes
    # the rank begins with the front, so one sort brings fronts together and orders them within
    ordered = placed.repartitionByRange(tasks, "_arrangement", "_rank").sortWithinPartitions("_arrangement", "_rank")
    found = keep(ordered.select("_arrangement", "_front", "_node", "_fp").mapInArrow(lambda batches: _cut_leaves(batches, words, distance), _FOUND_DDL), "simhash-leaves")
    leaves = found.where("members is not null").drop("a", "b")
    every = []
    for w in range(words):
        mask, pattern = F.col("mask")[w], F.col("pattern")[w]
        both = F.bit_and(pattern.bitwiseOR(F.bitwise_not(mask)))  # where all leaves share a bit, its value
        every += [F.bit_and(mask).bitwiseAND(F.bitwise_not(F.bit_or(pattern).bitwiseXOR(both))).alias(f"m{w}"), both.alias(f"p{w}")]
    nodes = leaves.groupBy("arrangement", "front", "upper").agg(*every)
    nodes = nodes.select("arrangement", "front", "upper", F.array(*[f"m{w}" for w in range(words)]).alias("m"), F.array(*[f"p{w}" for w in range(words)]).alias("p"))
    nodes = keep(nodes, "simhash-nodes")

    def close(m1: str, p1: str, m2: str, p2: str) -> Column:
        return F.expr(" + ".join(f"bit_count(({p1}[{w}] ^ {p2}[{w}]) & {m1}[{w}] & {m2}[{w}])" for w in range(words)) + f" <= {distance}")

    where = ["arrangement", "front"]
    left = nodes.select(*where, F.col("upper").alias("u1"), F.col("m").alias("m1"), F.col("p").alias("p1"))
    right = nodes.select(*where, F.col("upper").alias("u2"), F.col("m").alias("m2"), F.col("p").alias("p2"))
    pairs = left.join(right, where).where("u1 <= u2").where(close("m1", "p1", "m2", "p2")).select(*where, "u1", "u2")
    one, two = (leaves.select(*where, F.col("upper").alias(f"u{k}"), F.col("leaf").alias(f"l{k}"), F.col("mask").alias(f"k{k}"), F.col("pattern").alias(f"q{k}"), F.col("members").alias(f"members{k}")) for k in (1, 2))
    pairs = pairs.join(one, [*where, "u1"]).join(two, [*where, "u2"]).where("l1 <= l2").where(close("k1", "q1", "k2", "q2"))
    pairs = pairs.select("members1", F.when(F.col("l1") < F.col("l2"), F.col("members2")).alias("members2"), F.rand(1).alias("_deal"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.frombuffer(v.as_py(), np.int64).reshape(-1, 1 + words) if v.is_valid else None for v in (x, y))
                u, v = _links(a, b, distance)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    between = pairs.repartition("_deal").select("members1", "members2").mapInArrow(compare, "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(between)


# ---- components ------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node's links reach, for nodes with links.

    Star contraction: every node hands its greater neighbours to the least node
    it knows, then its lesser ones, until all links lead to roots. Minima are
    pre-aggregated and joins have a written table on either side, so Spark can
    split the partition of a hot node.
    """
    spark = edges.sparkSession
    now, path = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_at = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "components-least")
        large, large_at = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "components-large")
        lesser, lesser_at = kept(large.groupBy("a").agg(F.min("b").alias("m")), "components-lesser")
        small = large.join(lesser, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lesser.select("a", F.col("m").alias("b")))
        new, new_at = kept(small.where("a <> b").distinct(), "components")
        for old in (path, least_at, large_at, lesser_at):
            drop(spark, old)
        was, state = state, new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        now, path = new, new_at
        if tuple(was) == tuple(state):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def component_ids(least: DataFrame, stars: DataFrame) -> DataFrame:
    """(_node, component_id) for the nodes of (_node, _least): the smallest ``_least`` of its component; a null one counts only where all are."""
    known = least.withColumn("_least", F.coalesce("_least", F.lit(_NO_ID)))
    placed = keep(known.join(stars.withColumnRenamed("node", "_node"), "_node", "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root")), "component-roots")
    names = keep(placed.groupBy("_root").agg(F.min("_least").alias("component_id")), "component-names")
    return keep(placed.join(names, "_root").groupBy("_node").agg(F.nullif(F.min("component_id"), F.lit(_NO_ID)).alias("component_id")), "component-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, distance: int = DISTANCE, band: int | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits a word), component_id (the smallest id reachable)."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle, words), "simhash-rows")
    # ids repeated with another text would share a node, so nodes are numbered by fingerprint where that matters
    node = F.xxhash64("_fp") if words > 1 else F.col("_fp")[0]
    distinct = keep(rows.groupBy("_fp").agg(F.min("_id").alias("_least")).withColumn("_node", node), "simhash-distinct")
    named = component_ids(distinct.select("_node", "_least"), components(links(distinct.select("_node", "_fp"), words, distance, band)))
    hexed = F.array_join(F.transform("_fp", lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")
    return rows.withColumn("_node", node).join(named, "_node").select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _stay(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each ``_root`` of (_key, _least, _root) the text with the smallest id, then digest.

    Rows are told apart by text, not by id; equal rows leave one.
    """
    least = keep(named.groupBy("_root").agg(F.min(F.struct("_least", "_key")).alias("s")).select("s._key", "s._least"), "simhash-stay")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _text_key(text_col).alias("_key"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_least"))
    return boxed.join(least, ["_key", "_least"]).groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")


def _texts(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """(_key, _least, _node, _fp) of each distinct text; ``_node`` numbers its fingerprint."""
    rows = fingerprints(docs, id_col, text_col, shingle, words, keyed=True)
    texts = rows.groupBy("_key", "_fp").agg(F.min(F.coalesce("_id", F.lit(_NO_ID))).alias("_least"))
    return keep(texts.select("_key", "_least", F.xxhash64("_fp").alias("_node"), "_fp"), "simhash-texts")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1, distance: int = DISTANCE, band: int | None = None) -> DataFrame:
    """One row of ``docs`` for each component, all columns: that of the smallest id; among equal or null ids a digest of the text decides.

    Texts are only joined to the digests that stay.
    """
    texts = _texts(docs, id_col, text_col, shingle, words)
    stars = components(links(keep(texts.select("_node", "_fp").distinct(), "simhash-distinct"), words, distance, band)).withColumnRenamed("node", "_node")
    return _stay(docs, texts.join(stars, "_node", "left").select("_key", "_least", F.coalesce("root", "_node").alias("_root")), id_col, text_col)


# ---- candidates held against their shingles --------------------------------


def alike_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of the sets whose Jaccard likeness is at least ``ALIKE``; two empty sets are alike."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    several = counts > 1  # what only one set has is in no intersection
    kept_ = several[column]
    owner, column = owner[kept_], (np.cumsum(several) - 1)[column[kept_]]
    order = np.argsort(column, kind="stable")
    owner, column, common = owner[order], column[order], np.zeros((n, n), np.float64)
    step = 4096
    for low in range(0, int(several.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        has = np.zeros((n, step), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        common += has @ has.T
    over, under = ALIKE
    near = (over + under) * common >= over * (sizes[:, None] + sizes[None, :])
    return np.nonzero(np.triu(near, 1))


def alike_links(docs: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """(a, b): a spanning set of links between the digests of alike texts of one candidate component, of (_key, _root).

    Sets of shingles are only made of texts with candidates. A component of many texts is dealt out as
    pairs of blocks, so its sets are sent once for each block.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = texts.groupBy("_root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_root", blocks.alias("_blocks"))
    members = keep(texts.join(sizes, "_root").select("_key", "_root", "_blocks"), "simhash-candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), WIDE_SHINGLE).tobytes() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(found, pa.binary())], ["_key", "_set"])

    own = docs.select(_text_key(text_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    with_sets = keep(filtered(own, members, "_key").mapInArrow(sets, "_key long, _set binary").join(members, "_key").dropDuplicates(["_key"]), "simhash-sets")

    # of one block all pairs; of several each two blocks, which covers those within a block too
    mine = F.pmod(F.xxhash64("_key", "_root"), F.col("_blocks")).cast("int")
    dealt = with_sets.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_blocks = 1 or _mine <> _other")
    dealt = dealt.select("_root", F.least("_mine", "_other").alias("_one"), F.greatest("_mine", "_other").alias("_two"), "_key", "_set")

    def compare(unit: pa.Table) -> pa.Table:
        keys = unit.column("_key").to_numpy()
        node, root = _forest(len(keys), *alike_pairs([np.frombuffer(x.as_py(), np.uint64) for x in unit.column("_set")]))
        return pa.table({"a": pa.array(keys[node], pa.int64()), "b": pa.array(keys[root], pa.int64())})

    return dealt.groupBy("_root", "_one", "_two").applyInArrow(compare, "a long, b long")


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each component of texts alike to 0.8 by sets of five-word shingles, chosen as in :func:`drop_near_duplicates`.

    Fingerprints find candidates; only pairs whose sets are alike make a component.
    """
    words, band = wide_shape(docs.count())
    texts = _texts(docs, id_col, text_col, WIDE_SHINGLE, words)
    near = components(links(texts.select("_node", "_fp").distinct(), words, WIDE_DISTANCE * words, band)).withColumnRenamed("node", "_node")
    candidates = keep(texts.join(near, "_node", "left").select("_key", "_least", F.coalesce("root", "_node").alias("_root")), "simhash-near")
    alike = components(alike_links(docs, candidates.select("_key", "_root"), text_col)).withColumnRenamed("node", "_key")
    named = candidates.drop("_root").join(alike, "_key", "left").select("_key", "_least", F.coalesce("root", "_key").alias("_root"))
    return _stay(docs, named, id_col, text_col)
