"""SpotSigs against a plain version: signatures, all returned values, classes of near copies."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from bazaarline.llm import queries, spotsigs

ANCHORS = set(spotsigs.ANCHORS)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(x):
    return signed(xxhash.xxh64_intdigest(x.encode(), 42))


def plain_signatures(text, chain=2):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for k, w in enumerate(words):
        if w in ANCHORS and k + 1 < len(words) and words[k + 1] not in ANCHORS:
            content = [x for x in words[k + 1 :] if x not in ANCHORS]
            out.add(spark_hash(" ".join([w, *[*content, "."][:chain]])))
    return out or {spark_hash(" ".join(words))}


def plain_fingerprint(sigs):
    return f"{len(sigs)}-{hashlib.sha256(','.join(map(str, sorted(sigs))).encode()).hexdigest()}"


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def texts():
    rng = random.Random(4)
    words = [*spotsigs.ANCHORS[:12], *[f"w{k}" for k in range(60)], "Über", "naïve"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))
    out = [None, "", " \t", "the", "the of a", "cat", "the cat", "the the the cat the", "of the cat, and", "...", "The CAT", "日本語 the テキスト", "a" * 5000]
    out += [prose(rng.randint(1, 120)) for _ in range(40)]
    base = prose(300)
    for k in range(25):  # near copies, from few to many changed words
        changed = base.split()
        for at in rng.sample(range(len(changed)), k):
            changed[at] = f"new{k}x{at}"
        out.append(" ".join(changed))
    return out + [base, base, base.upper()]


TEXTS = texts()
ROWS = [(k * 2, t) for k, t in enumerate(TEXTS)] + [(None, "without an id the first"), (None, "without an id the second"), (10, "an id of two texts"), (10, "an id of two texts")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("_node", F.lit("clash")).withColumn("signatures", F.lit(1)).repartition(3)


def test_signatures(spark):
    one = "at a rally to kick off a weeklong campaign for the south carolina primary"
    rows = [(t or "",) for t in TEXTS] + [(one,)]
    for chain in (1, 2, 3):
        got = spotsigs.with_signatures(spark.createDataFrame(rows, "text string"), "text", "s", chain=chain).collect()
        assert all(len(set(r.s)) == len(r.s) and set(r.s) == plain_signatures(r.text, chain) for r in got)
    assert spark_hash("the south carolina") in plain_signatures(one)


@pytest.mark.parametrize("text", ["the " * 1_000_000 + "cat", "the cat " * 200_000, "a" * 1_000_000, "the " * 300_000, " " * 1_200_000])
def test_very_long_texts(spark, text):
    got = spotsigs.with_signatures(spark.createDataFrame([(text,)], "text string"), "text", "s").first()
    words = text.split()
    want = {spark_hash("the cat cat"), spark_hash("the cat .")} if "cat the" in text else {spark_hash("the cat .")} if "cat" in text else {spark_hash(" ".join(words))}
    assert set(got.s) == want


def test_all_values_by_brute_force(spark, docs):
    tie = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
    ordered = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        text, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_signatures(text), plain_signatures(edited), plain_signatures(after)
        want[(i, len(text), edited, plain_fingerprint(a), plain_fingerprint(b), round(plain_jaccard(a, b), 12), round(plain_jaccard(a, c), 12))] += 1
    # null ids differ in which comes first only by their digest, which decides for both sides alike
    got = Counter((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in spotsigs.compare_with_edits(docs).collect())
    assert got == want
    assert spotsigs.compare_with_edits(docs.limit(0)).count() == 0


def plain_classes(rows, likeness=0.8):
    sets = [plain_signatures(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if plain_jaccard(sets[i], sets[j]) >= likeness:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x].append(i)
    return Counter((i, min(least[x], default=None)) for (i, _), x in zip(rows, label, strict=True))


@pytest.mark.parametrize("likeness", [0.5, 0.8])
def test_classes_by_brute_force(docs, likeness):
    got = Counter((r.doc_id, r.near_class) for r in spotsigs.near_duplicates(docs, likeness=likeness).collect())
    assert got == plain_classes(ROWS, likeness)
    assert spotsigs.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_one_hot_block(spark):
    """Sets of few members around several centres, so that blocks hold many components."""
    rng = random.Random(9)
    sets = set()
    for c in range(6):
        centre = [c * 100 + k for k in range(14)] + [9000 + k for k in range(6)]
        for _ in range(60):
            x = set(centre)
            for _ in range(rng.randint(0, 4)):
                x.discard(rng.choice(centre))
                x.add(rng.randint(9000, 9040))
            sets.add(frozenset(x))
    sets = sorted(map(sorted, sets))
    rows = spark.createDataFrame(list(enumerate(sets)), "_node long, _sigs array<long>").repartition(4)
    root = {r.node: r.root for r in spotsigs.alike_components(rows).collect()}
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if plain_jaccard(set(sets[i]), set(sets[j])) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert [root.get(k, k) for k in range(len(sets))] == label


def test_unlike_sets_of_a_hot_block_are_not_fetched(spark, monkeypatch):
    """Some 45,000 pairs of sets that share most of their signatures, one in forty of them alike."""
    rng = random.Random(11)
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(29)]
    sets = sorted({tuple(sorted(rng.sample(pool, 24))) for _ in range(300)})
    asked, scored = [], spotsigs._scored
    monkeypatch.setattr(spotsigs, "_scored", lambda pairs, *a: asked.append(pairs.count()) or scored(pairs, *a))
    rows = spark.createDataFrame(list(enumerate(map(list, sets))), "_node long, _sigs array<long>").repartition(4)
    root = {r.node: r.root for r in spotsigs.alike_components(rows).collect()}
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if plain_jaccard(set(sets[i]), set(sets[j])) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert [root.get(k, k) for k in range(len(sets))] == label
    assert sum(asked) < 5000


def test_sets_with_signatures_of_their_own_are_through(spark, monkeypatch):
    """Though counters tell nothing, sets that share signatures by chance bring hardly any."""
    monkeypatch.setattr(spotsigs, "COUNTERS", 1)
    rng = random.Random(12)
    pool = [rng.getrandbits(64) - (1 << 63) for _ in range(200)]
    sets = [[*rng.sample(pool, 10), *(rng.getrandbits(64) - (1 << 63) for _ in range(30))] for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(sets)), "_node long, _sigs array<long>")
    assert spotsigs._prefixes(rows, 0.8).count() < 200


def test_size_partitions_are_neighbours(spark):
    rows = spark.range(1, 400).select(F.col("id").cast("int").alias("n"), spotsigs.size_partition(F.col("id"), 0.8).alias("p")).collect()
    part = {r.n: r.p for r in rows}
    assert all(0 <= part[b] - part[a] <= 1 for a in part for b in part if a <= b and 10 * a >= 8 * b)


def test_pruned_jaccard(spark):
    pair = spark.range(1).select(spotsigs.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3), F.lit(4))).alias("j"), spotsigs.jaccard(F.array(F.lit(1)), F.array(*[F.lit(k) for k in range(1, 9)]), 0.5).alias("p")).first()
    assert pair.j == pytest.approx(0.25) and pair.p == 0.0


def test_hot_and_null_ids_are_split(spark):
    rows = [(None, f"n{k}") for k in range(300)] + [(7, f"h{k}") for k in range(300)] + [(k, f"t{k}") for k in range(300)]
    table = spark.createDataFrame(rows, "_id long, _text string").withColumn("_tie", F.shiftrightunsigned(F.xxhash64("_text"), 1))
    dealt = spotsigs._dealt(table).collect()
    sizes = Counter(r._block for r in dealt)
    assert len(sizes) > 10 and max(sizes.values()) < 120
    by_block = sorted(dealt, key=lambda r: (r._block, r._id is not None, r._id or 0, r._tie))
    assert by_block == sorted(dealt, key=lambda r: (r._id is not None, r._id or 0, r._tie))


def test_query_has_all_columns(spark, tmp_path, docs):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_spotsigs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_class"]
    assert Counter((r.doc_id, r.near_class) for r in got.collect()) == plain_classes(ROWS)
