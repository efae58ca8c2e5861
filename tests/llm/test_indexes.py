"""Ranked search, source divergence and decontamination against plain versions of themselves."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarline.llm import decontaminate, divergence, lexical, queries
from bazaarline.llm.wavelet import Wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, rank int, score long, _text string, _id long, _row long, item_id string"
ITEMS = "item_id long, text string, term string, _text string, doc_id long"
WORDS, LETTERS = (re.compile(p) for p in (r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=WORDS):
    return pattern.findall((text or "").translate(LOWER))


def corpus():
    rng = random.Random(3)
    vocab = ["the", "a", "of", "Éa", "été", "x1", "9", "日本", "İ"] + [f"w{k}" for k in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".", "\n", "-"]) for _ in range(n))
    items = [(k, prose(rng.randint(10, 40))) for k in range(12)] + [(20, "Only Three words"), (21, "the"), (22, None), (23, ""), (24, "..."), (None, prose(14)), (25, "nowhere to be seen in any of the documents of this corpus"), (3, prose(12)), (26, "w1 " * 30)]
    texts = [None, "", "  ", "-_-", "the", "The THE the", "only three\nwords!", "w1 " * 5000, items[4][1], items[5][1].upper()]
    texts += [prose(rng.randint(1, 200)) for _ in range(60)]
    texts += [f"{prose(20)} {items[k % 12][1]} {prose(5)} {items[(k + 1) % 12][1][15:]}" for k in range(20)]
    texts += [texts[20]] * 3 + [prose(3000) + " " + items[2][1]]
    rows = [(k * 7 % 1000, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s3"][k % 4] if k % 3 else "s1", 0, "clash", 1, 2, "clash", 3, 4, "clash") for k, t in enumerate(texts)]
    rows += [rows[30], (None, texts[40], "zz", "alone", 1, "clash", 1, 2, "clash", 3, 4, "clash")]
    return rows, [(i, t, "clash", "clash", 1) for i, t in items]


ROWS, ASKED = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ASKED, ITEMS).repartition(2)


def plain_search(rows, asked, k):
    held = [(r[0], Counter(words(r[1]))) for r in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    terms = defaultdict(set)
    for i, text, *_ in asked:
        terms[i] |= set(words(text))
    out = []
    for i, ts in terms.items():
        scored = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * docs) // total
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(i, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for size, values in ((0, 1), (1, 1), (64, 2), (300, 37), (1000, 1000)):
        seq = rng.integers(0, values, size)
        levels = max(values - 1, 0).bit_length()
        tree = Wavelet(Wavelet.pack(seq, levels), levels, size)
        at = rng.integers(0, size + 1, 50)
        value = rng.integers(0, values, 50)
        assert tree.rank(value, at).tolist() == [int((seq[:a] == v).sum()) for v, a in zip(value, at, strict=True)]
        if size:
            at = rng.integers(0, size, 50)
            got, before = tree.access(at)
            assert got.tolist() == seq[at].tolist()
            assert before.tolist() == [int((seq[:a] == seq[a]).sum()) for a in at]


@pytest.mark.parametrize("shard", [{}, {"shard_words": 400, "shard_docs": 9}])
@pytest.mark.parametrize("k", [3, 50])
def test_search(docs, items, shard, k, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 100)
    found = lexical.search(lexical.build(docs, **shard), items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == plain_search(ROWS, ASKED, k)


def test_search_opens_few_nodes_at_a_time(docs, items, monkeypatch):
    """The best are the same however many nodes are opened together."""
    row = lexical.build(docs.coalesce(1)).rows.first().asDict()
    tree, number = lexical._Tree(row), {t: n for n, t in enumerate(bytes(row["terms"]).split())}
    asked = np.array(sorted({number[w.encode()] for w in words(ASKED[4][1]) if w.encode() in number}))
    weights = np.arange(1, len(asked) + 1)
    best = {}
    for width in (1, 7, 512):
        monkeypatch.setattr(lexical, "WIDTH", width)
        scores, found = tree.best(asked, weights, 5, 1)
        order = lexical._best([int(f) for f in found], scores, 5)
        best[width] = [(int(scores[p]), int(found[p])) for p in order]
    assert best[1] == best[7] == best[512]


def test_search_of_nothing(spark, docs, items):
    none = spark.createDataFrame([], SCHEMA)
    assert lexical.search(lexical.build(none), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0
    assert lexical.search(lexical.build(docs.where("text IS NULL")), items).count() == 0


# ---- divergence --------------------------------------------------------------


def plain_audit(rows):
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source, ts = r[2] or "", r[3] or "", words(r[1], LETTERS)
        groups.add((lang, source))
        seen[lang].update(set(ts))
        count[lang, source].update(ts)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= 3)
        v, sources = len(kept), sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda n, t: 1 + (10**9 * (n + 1)) // (t + v)
        p = {s: [share(count[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            own = [(-((a - b) ** 2 // b), t) for a, b, t in zip(p[s], q, kept, strict=True) if count[lang, s][t] and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, o, -x, k) for k, (x, o) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize("slice_", [1 << 19, 25, 3])
def test_audit(docs, slice_, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    found = divergence.audit(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == plain_audit(ROWS)


def test_audit_of_little(spark, docs):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [r for r in ROWS if r[1] in (None, "", "the")]
    assert Counter(map(tuple, divergence.audit(spark.createDataFrame(few, SCHEMA)).collect())) == plain_audit(few)


def test_audit_of_many_terms(spark):
    """More terms than a source reports, and ties in order of bytes."""
    rows = [(k, " ".join(f"t{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)) + " é" * k, "x", f"s{k % 2}") for k in range(6)]
    rows += [(9, " ".join(f"t{chr(97 + a)}b " * (a + 1) for a in range(20)), "x", "s9")]
    got = Counter(map(tuple, divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()))
    assert got == plain_audit(rows)


# ---- decontamination -----------------------------------------------------------


def plain_hits(rows, asked):
    windows = defaultdict(set)
    for i, text, *_ in asked:
        ws = words(text)
        if ws:
            windows["" if i is None else str(i)] |= {tuple(ws[k : k + 10]) for k in range(max(1, len(ws) - 9))}
    out = []
    for r in rows:
        ws, hit, found = words(r[1]), set(), set()
        own = defaultdict(list)
        for n in {len(w) for x in windows.values() for w in x}:
            for k in range(len(ws) - n + 1):
                own[tuple(ws[k : k + n])].append(k)
        for i, x in windows.items():
            for w in x:
                for k in own.get(w, ()):
                    hit |= set(range(k, k + len(w)))
                    found.add(i)
        out.append((r[0], len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("shard", [{}, {"shard_words": 64, "shard_docs": 5}])
def test_decontamination(docs, items, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 40 if shard else 1 << 16)
    found = decontaminate.report(docs, items, **shard)
    rows = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    assert Counter(map(tuple, rows.collect())) == plain_hits(ROWS, ASKED)
    for r in found.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_removal_leaves_nothing_to_find(docs, items):
    cleaned = decontaminate.remove(docs, items)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    before = {(r["doc_id"], r["n_words"] - r["n_hit"]) for r in decontaminate.report(docs, items).collect()}
    after = {(r["doc_id"], len(words(r["text"]))) for r in cleaned.collect()}
    assert before == after


def test_suffixes():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1), (2, 3), (50, 2), (300, 5), (4000, 3), (500, 1 << 22)):
        ranks = np.append(rng.integers(1, most + 1, n), 0)
        if n == 4000:
            ranks[:4000] = np.tile(ranks[:500], 8)  # long repeats
        got = decontaminate.suffixes(ranks, most)
        assert got.tolist() == sorted(range(n + 1), key=lambda p: ranks[p:].tolist())


def test_nothing_to_decontaminate(spark, docs, items):
    none = spark.createDataFrame([], SCHEMA)
    assert decontaminate.report(none, items).count() == 0
    for r in decontaminate.report(docs, items.where("text IS NULL")).collect():
        assert r["n_hit"] == 0 and r["items"] == [] and r["spans"] == []


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    docs, asked = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in asked.collect()]
    assert Counter(map(tuple, queries.op11_lexical(spark, d).select("item_id", "rank", "doc_id", "score").collect())) == plain_search(rows, items, 50)
    assert Counter(map(tuple, queries.op12_divergence(spark, d).collect())) == plain_audit(rows)
    assert Counter(map(tuple, queries.op13_decontaminate(spark, d).collect())) == plain_hits(rows, items)
