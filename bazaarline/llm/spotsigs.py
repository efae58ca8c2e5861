"""SpotSigs fingerprints and near copies, in DataFrame operations only.

A signature is a common word, the anchor, with the next content words after it,
common words between them left out. Of common words in a row the last is the
anchor, as the others would begin the same chain; so each word is looked at a few
times only, and a text costs linear time. Articles and the like stand everywhere in
running prose and hardly in lists and boilerplate, so the set of a text's
signatures is its fingerprint.

Near copies are sets alike to ``ALIKE`` by Jaccard similarity
(:func:`near_classes`). Each set brings its rarest signatures, by counters of a fixed
number, and some more than it has to, so that sets so alike have several in common. What
is brought is counted exactly, in one shuffle by signature; a set most of whose signatures no other
brings has no near copy and is through. Of the others the few rarest signatures that sets so alike
can't all miss are blocks, dealt out by set size: a partition of sizes and the next one hold all
that can be alike. In a block every set is compared with ``PIVOTS`` others, the first being the one
that has most of its signatures in common with others; that links the copies of one text
without all their pairs. Sets of a block that are still in different components are compared
in pairs. Two sets are only fetched and compared if neither their sizes, nor the place of the signature among
theirs, nor their sketches of ``SKETCH`` words, whose bits differ in no more places than the
sets, rule out the wanted likeness. Any order of signatures gives the same links.

Defined cases: null text counts as empty; a text without signatures has its
normalised words as its only one, so equal texts always have equal fingerprints;
repeated rows get a row each; an empty table gives no rows; columns other than
id and text are not read; a null id is the last in descending order and never
names a class unless all its ids are null; rows of one id follow each other by a
digest of their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .membership import filtered
from .simhash import component_ids, components
from .storage import drop, finished, keep, work_tables

#: Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "the a of and to in is that for it as on are be this was with by an at or from "
    "le la les de des du un une et en que qui est dans pour par sur au "
    "der die das und zu den von mit ist im ein eine nicht auf für "
    "el los las y es con por para del se su al una"
).split()
#: Content words in a chain.
CHAIN = 2
#: Likeness of near copies, and counters that order signatures by how often they occur.
ALIKE, COUNTERS = 0.8, 1 << 16
#: Share of the signatures that alike sets surely have in common that prefixes are longer by; the longer, the fewer sets have to be compared.
SURPLUS = 0.25
#: Words of 64 bits in a sketch, a power of two.
SKETCH = 4
#: Sets of a block that all others are compared with before the rest is compared in pairs.
PIVOTS = 2
#: Rows for each block that the bounds of blocks are estimated from.
PER_BOUND = 64
_END = "."


def _trie(words: list[str]) -> str:
    """A pattern for any of ``words`` that looks at each letter once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None)
    branches = [head + _trie(rest) for head, rest in sorted(heads.items())]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
    return body + ("?" if ends else "")


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the set ``out`` of signatures of a text column that is not null.

    A signature is the hash of an anchor and its chain, with a space between words;
    a full stop for the end of the text ends a chain. What is used twice has a column,
    as Spark would compute it twice.
    """
    anchor = f"(?:{_trie(sorted(set(anchors)))})"
    first = rf" (?=({anchor} (?!{anchor} |\{_END})[^ ]++(?: (?:{anchor} )*+[^ ]++){{0,{chain - 1}}}+))"
    df = df.withColumn("_norm", normalised(F.col(text)))
    df = df.withColumn("_chains", F.array_join(F.regexp_extract_all(F.concat(F.lit(" "), "_norm", F.lit(f" {_END}")), F.lit(first), F.lit(1)), "|"))
    bare = F.regexp_replace("_chains", f" {anchor}(?= )", "")  # all but the first word are content words once the anchors among them are gone
    hashes = F.array_distinct(F.transform(F.split(bare, r"\|"), lambda s: F.xxhash64(s)))
    return df.withColumn(out, F.when(F.col("_chains") == "", F.array(F.xxhash64("_norm"))).otherwise(hashes)).drop("_norm", "_chains")


def fingerprint(sigs: Column) -> Column:
    """The set as one value: its size and the digest of its sorted members."""
    return F.concat_ws("-", F.size(sigs).cast("string"), F.sha2(F.array_join(F.array_sort(sigs).cast("array<string>"), ","), 256))


def size_partition(size: Column, likeness: float) -> Column:
    """Sets at least so alike are in the same partition or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / -F.log(F.lit(likeness)) + 1e-9).cast("int")


def jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where their sizes rule out ``at_least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    exact = same.cast("double") / (F.size(a) + F.size(b) - same)
    return F.when(small >= large * F.lit(at_least - 1e-9), exact).otherwise(F.lit(0.0)) if at_least else exact


# ---- near copies -----------------------------------------------------------


def _frequencies(rows: DataFrame) -> DataFrame:
    """One row: ``_often``, an array of ``COUNTERS`` bytes, the binary length of how often signatures of each counter occur."""
    counted = rows.select(F.explode("_sigs").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).alias("slot")).agg(F.length(F.bin(F.count(F.lit(1)))).cast("tinyint").alias("c"))
    every = rows.sparkSession.range(COUNTERS).withColumnRenamed("id", "slot").join(counted, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("c", F.lit(0).cast("tinyint")).alias("c")))), lambda x: x["c"]).alias("_often"))


def _left(size: Column, likeness: float) -> Column:
    """How many of a set's signatures are not looked at: of those that any alike set of its size shares, all but the ``SURPLUS``."""
    common = F.ceil(size * likeness - 1e-9).cast("int")
    return common - F.ceil(common * SURPLUS).cast("int")


def _prefixes(rows: DataFrame, likeness: float) -> DataFrame:
    """(_node, _size, _token, _place, _weight): of each set as many of its rarest signatures as sets so alike can't all miss.

    Each set brings its ``_size - _left`` first signatures in the order of ``_often``; alike sets have at least ``ceil(common * SURPLUS)`` of
    them in common. Among these, how many sets bring a signature is counted exactly, and that is the order of rarity: what one set alone
    brings comes first, and a set that has enough of it is through. ``_place`` is the signature's place among what its set brings.
    """
    rare = F.sort_array(F.expr(f"transform(_sigs, s -> struct(element_at(_often, cast(pmod(s, {COUNTERS}) AS int) + 1) AS c, s AS s))"))
    sized = rows.withColumn("_size", F.size("_sigs"))
    brought = sized.crossJoin(F.broadcast(_frequencies(rows))).select("_node", "_size", F.explode(F.slice(rare, F.lit(1), F.col("_size") - _left(F.col("_size"), likeness))).alias("_rare")).select("_node", "_size", F.col("_rare.s").alias("_token"))  # one row, its size fixed by COUNTERS
    # copies have one node
    held = brought.repartition("_token").groupBy("_token", "_node").agg(F.first("_size").alias("_size"))
    shared = held.withColumn("_sets", F.count(F.lit(1)).over(Window.partitionBy("_token"))).where("_sets > 1")
    own = Window.partitionBy("_node")
    ranked = shared.withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_rank", F.row_number().over(own.orderBy("_sets", "_token")))
    placed = ranked.withColumn("_place", (F.col("_size") - _left(F.col("_size"), likeness) - F.col("_n") + F.col("_rank") - 1).cast("int"))
    needed = placed.where(F.col("_place") <= F.col("_size") - F.ceil(F.col("_size") * likeness - 1e-9))
    return needed.select("_node", "_size", "_token", "_place", F.count(F.lit(1)).over(own).alias("_weight"))


def sketch(sigs: str, k: int) -> Column:
    """Word ``k`` of a set's sketch: each signature turns one bit, so two sets differ in as many signatures as their sketches in bits, at least."""
    mine = f"filter({sigs}, s -> (shiftright(s, 20) & {SKETCH - 1}) = {k})"
    return F.expr(f"aggregate({mine}, 0L, (x, s) -> x ^ shiftleft(1L, cast(shiftright(s, 30) & 63 AS int)))")


def _scored(pairs: DataFrame, rows: DataFrame, at_least: float) -> DataFrame:
    """(a, b, j): the likeness of the sets of two nodes. Only sets that some pair names are moved."""
    nodes = keep(pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct(), "spot-nodes")
    held = filtered(rows, nodes, "_node").groupBy("_node").agg(F.first("_sigs").alias("_sigs"))
    held = keep(held, "spot-sets")
    one, two = held.select(F.col("_node").alias("a"), F.col("_sigs").alias("s1")), held.select(F.col("_node").alias("b"), F.col("_sigs").alias("s2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", jaccard(F.col("s1"), F.col("s2"), at_least).alias("j"))


def _possible(one: str, two: str, likeness: float) -> Column:
    """Whether sizes, the places of a common signature that is the first one, and sketches leave the wanted likeness possible.

    ``one`` and ``two`` make the names of a set's columns from ``_size``, ``_place`` and ``_sketch0`` on.
    """
    size1, size2, place1, place2 = (F.col(x.format(c)) for c in ("_size", "_place") for x in (one, two))
    left1, left2 = _left(size1, likeness), _left(size2, likeness)
    # if the signature is the first that both bring, so many that both bring can follow, itself included; what one doesn't bring, both may have besides
    common = F.least(size1 - left1 - place1, size2 - left2 - place2) + F.greatest(left1, left2)
    apart = F.expr(" + ".join(f"bit_count({one.format(f'_sketch{k}')} ^ {two.format(f'_sketch{k}')})" for k in range(SKETCH)))
    both = size1 + size2
    sizes = F.least(size1, size2) >= F.greatest(size1, size2) * F.lit(likeness - 1e-9)
    return sizes & (common >= both * F.lit(likeness / (1 + likeness) - 1e-9)) & (apart <= both * F.lit((1 - likeness) / (1 + likeness) + 1e-9))


def alike_components(rows: DataFrame, likeness: float = ALIKE) -> DataFrame:
    """(node, root): the smallest node that links between alike sets reach, for the nodes of (_node, _sigs) with links."""
    with work_tables() as made:
        found = _alike_components(rows, likeness)
    for path in made[:-1]:  # the last one is the result
        drop(rows.sparkSession, path)
    return found


def _alike_components(rows: DataFrame, likeness: float) -> DataFrame:
    where, names = ["_part", "_token"], ["_node", "_size", "_place", *(f"_sketch{k}" for k in range(SKETCH))]
    with work_tables() as first:
        prefixes = keep(_prefixes(rows, likeness), "spot-prefixes")
        nodes = keep(prefixes.select("_node").distinct(), "spot-live")
        sketches = filtered(rows, nodes, "_node").select("_node", *(sketch("_sigs", k).alias(f"_sketch{k}") for k in range(SKETCH)))
        sketches = sketches.groupBy("_node").agg(*(F.first(f"_sketch{k}").alias(f"_sketch{k}") for k in range(SKETCH)))
        live = finished(prefixes.join(sketches, "_node"), "spot-sketched", first)
    part = size_partition(F.col("_size"), likeness)
    blocks = live.withColumn("_part", F.explode(F.array(part, part - 1)))
    # the set in the middle of copies shares most of its signatures with others; the other pivots are drawn, as far as blocks have the same sets the same ones
    picked = [F.max(F.struct((F.xxhash64("_node", F.lit(k)) if k else F.col("_weight")).alias("_by"), *names)) for k in range(PIVOTS)]
    pivots = blocks.groupBy(*where).agg(F.array(*picked).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*where, "p")
    asked = blocks.join(pivots, where).withColumn("p", F.explode("p")).where((F.col("_node") != F.col("p._node")) & _possible("{}", "p.{}", likeness))
    asked = keep(asked.select(F.least("_node", "p._node").alias("a"), F.greatest("_node", "p._node").alias("b")).distinct(), "spot-asked")
    links = keep(_scored(asked, rows, likeness).where(F.col("j") >= likeness - 1e-9).select("a", "b"), "spot-links")
    roots = components(links)
    rooted = live.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node"))
    rooted = keep(rooted.select("_token", "_root", *names), "spot-rooted").withColumn("_part", F.explode(F.array(part, part - 1)))
    # a block all of whose sets are of one component is through
    open_ = rooted.groupBy(*where).agg(F.min("_root").alias("lo"), F.max("_root").alias("hi")).where("lo <> hi").select(*where)
    rest = rooted.join(open_, where, "left_semi")
    one, two = (rest.select(*where, *[F.col(c).alias(f"{c}{k}") for c in ("_root", *names)]) for k in (1, 2))
    ordered = (F.col("_size1") < F.col("_size2")) | ((F.col("_size1") == F.col("_size2")) & (F.col("_node1") < F.col("_node2")))
    once = size_partition(F.col("_size1"), likeness) == F.col("_part")  # others meet in the smaller one's other partition too
    pairs = one.join(two, where).where(ordered & once & (F.col("_root1") != F.col("_root2")) & _possible("{}1", "{}2", likeness))
    pairs = keep(pairs.select(F.col("_node1").alias("a"), F.col("_node2").alias("b")).distinct(), "spot-pairs")
    more = _scored(pairs, rows, likeness).where(F.col("j") >= likeness - 1e-9).select("a", "b")
    return components(links.unionByName(more))


def near_classes(rows: DataFrame, likeness: float = ALIKE) -> DataFrame:
    """(fingerprint, near_class) for the different fingerprints of (_id, fingerprint, signatures).

    ``near_class`` is the smallest id that chains of sets alike to ``likeness``
    reach. Equal sets are one node; nodes are 64-bit digests of fingerprints.
    """
    rows = rows.withColumn("_node", F.xxhash64("fingerprint"))
    least = keep(rows.groupBy("fingerprint", "_node").agg(F.min("_id").alias("_least")).withColumn("_lead", F.xxhash64("_node", "_least")), "spot-least")
    # of copies about one brings its set; which others do is of no matter
    sets = filtered(rows.withColumn("_lead", F.xxhash64("_node", "_id")), least, "_lead").select("_node", F.col("signatures").alias("_sigs"))
    named = component_ids(least.select("_node", "_least"), alike_components(sets, likeness))
    return least.select("fingerprint", "_node").join(named, "_node").select("fingerprint", F.col("component_id").alias("near_class"))


# ---- a document and the next ------------------------------------------------


def _below(x: str, how: str) -> Column:
    """How many of the sorted array ``_bounds`` are ``how`` (``<`` or ``<=``) ``x``, by halving."""
    middle = "cast((a.lo + a.hi) div 2 AS int)"
    step = f"CASE WHEN a.lo >= a.hi THEN a WHEN _bounds[{middle}] {how} {x} THEN named_struct('lo', {middle} + 1, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', {middle}) END"
    return F.expr(f"aggregate(sequence(0, length(bin(size(_bounds)))), named_struct('lo', 0, 'hi', size(_bounds)), (a, i) -> {step}, a -> a.lo)")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_block``: ascending blocks are ascending ids, null first; rows of one id that fills several blocks are split by ``_tie``.

    Bounds come from a sample and only say where to cut.
    """
    blocks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, PER_BOUND * blocks / max(1, rows.count()))
    drawn = rows.select("_id").sample(share, 7) if share < 1 else rows.select("_id")
    cuts = F.percentile_approx("_id", [k / blocks for k in range(1, blocks)], PER_BOUND * blocks)
    bounds = drawn.agg(F.coalesce(F.sort_array(cuts), F.array().cast("array<bigint>")).alias("_bounds"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("_id").isNull()) * blocks / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("_nulls"))
    within = F.col("_tie") / F.lit(float(1 << 63))
    low, high = _below("_id", "<"), _below("_id", "<=")
    block = F.when(F.col("_id").isNull(), F.floor(within * F.col("_nulls")) - F.col("_nulls")).otherwise(low + F.floor(within * (high - low + 1)))
    return rows.crossJoin(F.broadcast(keep(bounds, "spot-bounds"))).withColumn("_block", block.cast("int")).drop("_bounds", "_nulls")  # one row


def with_next(rows: DataFrame, enriched: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``enriched(rows)`` (of _id, _tie and more) with ``_next``, a struct of ``columns`` of the next row by descending id, the first after the last.

    Rows are dealt to blocks of ids and follow each other within their block; the
    last row of a block looks at the first of the next. ``_tie`` is a long from 0 on.
    """
    dealt = _dealt(rows)
    order = Window.partitionBy("_block").orderBy(F.col("_id").asc_nulls_first(), "_tie")
    down = Window.partitionBy("_block").orderBy(F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    ahead = F.struct(*columns)
    # texts are dealt out before they are enriched, so only they are moved
    placed = enriched(dealt.repartition("_block")).withColumn("_ahead", F.lag(ahead).over(order))
    blocks = keep(dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")), "spot-blocks")
    upwards = Window.orderBy("_block")  # one row per block
    follow = blocks.select("_block", F.coalesce(F.lag("_block").over(upwards), F.max("_block").over(Window.partitionBy())).alias("_follows"))
    first = dealt.withColumn("_place", F.row_number().over(down)).where("_place = 1")  # pruned to one row of a block and task first
    heads = enriched(first).select(F.col("_block").alias("_follows"), ahead.alias("_head"))
    ends = follow.join(heads, "_follows").select("_block", "_head")
    return placed.join(ends, "_block", "left").withColumn("_next", F.coalesce("_ahead", "_head")).drop("_ahead", "_head", "_block")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, the text whose end is the next document's start, both fingerprints, likenesses and the set of signatures."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.shiftrightunsigned(F.xxhash64("_text"), 1))
    pairs = with_next(rows, lambda df: with_signatures(df, "_text", "_sigs"), ["_text", "_sigs"]).withColumn("_n", F.length("_text")).withColumn("_half", F.floor(F.col("_n") / 2).cast("int"))
    pairs = pairs.withColumn("_edited", F.concat(F.expr("substring(_text, 1, _n - _half)"), F.expr("substring(_next._text, 1, _half)")))
    pairs = with_signatures(pairs, "_edited", "_edited_sigs")
    return pairs.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_chars"),
        F.col("_edited").alias("edited"),
        fingerprint(F.col("_sigs")).alias("fingerprint"),
        fingerprint(F.col("_edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("_sigs"), F.col("_edited_sigs")).alias("near_edited"),
        jaccard(F.col("_sigs"), F.col("_next._sigs")).alias("near_next"),
        F.col("_sigs").alias("signatures"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness: float = ALIKE) -> DataFrame:
    """One row per input row: id, fingerprint, near_class (the smallest id that near copies reach)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sets = with_signatures(rows, "_text", "signatures").select("_id", fingerprint(F.col("signatures")).alias("fingerprint"), "signatures")
    sets = keep(sets, "spot-rows")
    return sets.select("_id", "fingerprint").join(near_classes(sets, likeness), "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "near_class")
