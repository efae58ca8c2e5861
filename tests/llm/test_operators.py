"""Each operator against a plain version of itself, on edge cases and a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bazaarline.llm import bpe_chunks, exact_dedup, language, membership, mixing, quality, queries, sanitise, simhash, storage, token_counts, token_files
from bazaarline.llm.bpe_kernel import Encoder

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, _key long, _row string, size string, copies string, _len int"
EN = "the cat of that house is on a mat and it was with the dog for an hour in which nobody came to see them".split()
DE = "der hund und die katze sind in dem haus mit einer maus auf dem tisch von zu den kindern ist nicht".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    rng = random.Random(7)
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en", ".", ","]) for _ in range(n))
    texts = [None, "", " ", "\n\t", "a", "a", "one  two\tthree", "one two three", "one two\n three", "x" * 3000, "é" * 500, "<|endoftext|> and <|endof", "日本語 のテキスト です", "1234 5678", "...!!!"]
    texts += ["mail a.b@c.de or +44 20 7946 0958, 10.0.0.1, 999.1.1.1, 4111 1111 1111 1111 4111111111111112"]
    shared = prose(EN, 400)
    texts += [prose(EN if k % 3 else DE, rng.randint(1, 300)) for k in range(60)]
    texts += [f"{prose(EN, 30)} {shared} {prose(EN, 20)}" for _ in range(6)]
    texts += [shared, shared, shared + " end", prose(DE, 20_000)]
    langs = [None if t is None or k % 17 == 0 else ("de" if "katze" in t or "hund" in t else "en") for k, t in enumerate(texts)]
    rows = [(k * 3, t, langs[k], [None, "s1", "s2", "é"][k % 4], len(t or ""), "clash", -1, -2, "clash", "clash", "clash", 5) for k, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((None, "a text without an id " + "word " * 30, "en", "s1", 20, None, None, None, None, None, None, None))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# ---- storage and membership


def test_membership_has_no_false_negative(spark):
    keys = spark.range(1000).select((F.col("id") * 7919 - 300_000).alias("k"))
    marks = membership.bitmap(keys, "k")
    assert marks.bits == 1 << 15 and membership.bits_for(1_000_000) == 1 << 24 and membership.bits_for(1 << 40) == membership.MOST
    assert membership.with_membership(keys, marks, "k", "m").where("m").count() == 1000
    assert membership.with_membership(spark.range(10_000_000, 10_004_000).toDF("k"), marks, "k", "m").where("m").count() < 400
    assert membership.filtered(keys, keys.limit(0), "k").count() == 0


def test_work_tables_are_dropped(spark):
    where = spark._jvm.org.apache.hadoop.fs.Path
    with storage.work_tables() as made:
        out = storage.finished(storage.keep(spark.range(5), "one").withColumn("x", F.lit(1)), "two", made)
    files = where(made[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert [files.exists(where(p)) for p in made] == [False, True] and out.count() == 5


# ---- 1


def test_bpe_round_trip(docs, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    got = bpe_chunks.decode(bpe_chunks.encode(docs, BYTE_BPE), BYTE_BPE).collect()
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in ROWS)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe_chunks.encode(empty, BYTE_BPE).count() == 0


def test_chunks_are_shared_and_joins_repaired():
    rng = random.Random(3)
    kernel = Encoder(BYTE_BPE)
    shared = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    one, two = ("alpha " * 40 + shared).encode(), ("beta, gamma\n" * 70 + shared + " omega").encode()
    digests = [{d for _, _, d in bpe_chunks.chunks(x)} for x in (one, two)]
    both = digests[0] & digests[1]
    assert len(both) > len(digests[0]) / 2
    known = {d: kernel.encode(raw[s:e].decode()).tobytes() for raw in (one, two) for s, e, d in bpe_chunks.chunks(raw) if d in both}
    for raw in (one, two):
        assert bpe_chunks.assemble(raw, known, kernel).tolist() == kernel.by_library(raw.decode()).tolist()


def test_assemble_is_exact_whatever_is_known(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MEAN", 16)
    monkeypatch.setattr(bpe_chunks, "LEAST", 4)
    monkeypatch.setattr(bpe_chunks, "MOST", 64)
    rng, kernel = random.Random(5), Encoder(BYTE_BPE)
    parts = ["a", "the ", " ", "  ", "\n", "'re", "it's", "<|endoftext|>", "é", "—", "12", "!", "word ", "日", " "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        raw = text.encode()
        cut = bpe_chunks.chunks(raw)
        assert "".join(raw[s:e].decode() for s, e, _ in cut) == text
        known = {d: kernel.encode(raw[s:e].decode()).tobytes() for s, e, d in cut if rng.random() < 0.7}
        assert bpe_chunks.assemble(raw, known, kernel).tolist() == kernel.by_library(text).tolist()


# ---- 2


def plain_targets(sizes):
    """Reshare the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if free else {}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing(docs, empty):
    got = mixing.with_copies(docs, carry=[]).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += size(r[1])
    targets, source = plain_targets(dict(sizes)), {r[0]: r[3] for r in ROWS}
    assert len(got) == len(ROWS)
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r._id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3 * largest[s] + 1
    assert Counter((r._id, r.copies) for r in got) == Counter((r._id, r.copies) for r in mixing.with_copies(docs.repartition(5), carry=[]).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.with_copies(empty, carry=[]).count() == 0


# ---- 3


def test_quality_learns_and_handles_edges(spark, docs, empty):
    good = [(k, " ".join(EN[(k + j) % len(EN)] for j in range(40 + k % 30)) + ".") for k in range(200)]
    bad = [(1000 + k, " ".join(EN[(k * 3 + j) % len(EN)].upper() + "!!" for j in range(30 + k % 40))) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad] + [(None, 1, 0), (5, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(table, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(r.predicted == int(k < 1000) and 0 <= r.score <= 1 for k, r in got.items())
    assert {r.doc_id for r in quality.keep_good(table, labels).collect()} == {k for k, _ in good}
    assert quality.score_documents(docs, labels).where("score between 0 and 1").count() == len(ROWS)
    one, same = quality.fit(table, labels), quality.fit(table.repartition(7), labels)
    assert one.mean == pytest.approx(same.mean) and one.inverse == pytest.approx(same.inverse, abs=1e-5)
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0 and quality.keep_good(empty, labels).columns == empty.columns


def test_discriminant_is_a_density_ratio():
    rng = np.random.default_rng(0)
    p = len(quality.NAMES)
    model = quality.Model(np.zeros((2, p)), np.array([np.eye(p), np.eye(p) / 2]), np.array([0.0, 2 * p * np.log(2)]), np.log([0.5, 0.5]))
    x = rng.normal(size=(5, p))
    density = lambda x, s: np.exp(-0.5 * (x * x).sum(1) / s**2) / s**p
    assert model.scores(x) == pytest.approx(density(x, 2) / (density(x, 1) + density(x, 2)))


# ---- 4


def test_token_counts_and_cache(spark, docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in ROWS)
    cache = storage.work_path(spark, "test-counts")
    for n in (3, 5):  # the second time from the cache alone
        assert Counter(map(tuple, token_counts.count_tokens(docs.repartition(n), cache, PIECE_BPE).collect())) == want
        assert token_counts.read_cache(spark, cache).count() == len({r[1] or "" for r in ROWS})
    more = spark.createDataFrame([(1, "a new text"), (2, "a")], "doc_id long, text string")
    assert Counter(map(tuple, token_counts.count_tokens(more, cache, PIECE_BPE).collect())) == Counter([(1, 10, len(model.encode("a new text"))), (2, 1, len(model.encode("a")))])
    # what is encoded is appended, so no text of the cache was encoded again, even with a bitmap that is full
    half = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1").withColumn("text", F.concat(F.lit("new "), F.coalesce("text", F.lit("")))))
    assert token_counts.count_tokens(half, cache, PIECE_BPE, most=1 << 15).count() == len(ROWS) - 1
    texts = {r[1] or "" for r in ROWS} | {"a new text"} | {"new " + (r[1] or "") for r in ROWS if r[0] is not None and r[0] % 2}
    assert token_counts.read_cache(spark, cache).count() == len(texts)
    library = Tokenizer.from_file(BYTE_BPE)
    assert {r.n_tokens for r in token_counts.count_tokens(more, cache, BYTE_BPE).collect()} == {len(library.encode(t).ids) for t in ("a new text", "a")}
    assert token_counts.count_tokens(empty, storage.work_path(spark, "test-counts"), PIECE_BPE).count() == 0


# ---- 5


def test_language(spark, docs, empty):
    got = language.predict_languages(docs).collect()
    known = {r[0]: r for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        text = known[r.doc_id][1]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("de", "en") and 0 <= r.score <= 1
            if known[r.doc_id][2] and len(text) > 100 and " " in text:
                assert r.lang_pred == known[r.doc_id][2]
    assert language.predict_languages(empty).count() == 0
    assert {r.lang_pred for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_texts_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_GRAMS", 4000)
    rows = [(k, " ".join((EN, DE)[k % 2][j % 17] for j in range(k, k + 60)), ("en", "de")[k % 2]) for k in range(60)] + [(100, "raro " * 50, "xx")]
    got = {r.doc_id: r for r in language.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(60)) and {r.lang_pred for r in got.values()} <= {"en", "de", "xx"}


def test_no_language_is_dropped(spark, monkeypatch):
    """600 languages, the last of them with few documents, under a sample that is too small for them."""
    monkeypatch.setattr(language, "SAMPLED", 3000)
    letters, rng = "abcdefghijklmnopqrstuvwxyz", random.Random(1)
    own = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for k in range(600)}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(40))) for k, (lang, w) in enumerate(own.items()) for _ in range(6 if k > 590 else 12)]
    rows = [(k, text, lang) for k, (lang, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.predict_languages(docs).collect()
    learned = {rows[r.doc_id][2] for r in got if not r.held_out}
    held = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")).where(~language.held_out(F.col("_id")))
    assert set(language.train(held).languages) == learned and len(learned) > 590
    assert sum(r.lang_pred in own for r in got) == len(got)
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out and rows[r.doc_id][2] in learned) > 0.9 * sum(r.held_out for r in got)


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "Ein  kleiner Text, über Häuser " * 30
    whole = np.bincount(np.concatenate(list(language.grams(text))), minlength=language.BUCKETS)
    monkeypatch.setattr(language, "_PIECE", 1 << 30)
    assert (np.bincount(np.concatenate(list(language.grams(text))), minlength=language.BUCKETS) == whole).all()


# ---- 6


def plain_fingerprint(text, shingle=3):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[k : k + shingle]) for k in range(max(1, len(found) - shingle + 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def plain_components(fps, distance):
    nodes = sorted(set(fps))
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_fingerprints(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in ROWS}
    roots = plain_components(fps.values(), 3)
    least = defaultdict(list)
    for k, f in fps.items():
        if k is not None:
            least[roots[f]].append(k)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{fps[r[0]]:016x}", min(least[roots[fps[r[0]]]], default=None)) for r in ROWS)
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({r.component_id if r.component_id is not None else None for r in got})


def clustered(n, spread, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("leaf", "blocks"), [(8, 4), (512, 4), (8, 5), (64, 6)])
def test_index_finds_all_links_of_hot_groups(spark, monkeypatch, leaf, blocks):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "UPPER", 4)
    fps = clustered(1200, 5, leaf)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x, [x]) for x in signed], "_node long, _fp array<long>").repartition(5)
    edges = simhash.links(rows, blocks=blocks)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    roots = plain_components(fps, 3)
    plain, found = defaultdict(set), defaultdict(set)
    for x, s in zip(fps, signed, strict=True):
        plain[roots[x]].add(s)
        found[got.get(s, s)].add(s)
    assert sorted(map(sorted, plain.values())) == sorted(map(sorted, found.values()))


def test_fronts_get_longer_with_the_data():
    assert [simhash.front_blocks(n, 3) for n in (1, 1 << 22, 1 << 23, 1 << 31, 1 << 40)] == [4, 4, 5, 5, 6]
    for blocks, ways in ((4, 4), (5, 10), (6, 20)):
        found = simhash._arrangements(1, 3, None, blocks)
        assert len(found) == ways and all(sorted(x for low, high in order for x in range(low, high)) == list(range(64)) for _, order, _ in found)
        assert min(width for _, _, width in found) >= (16, 25, 31)[blocks - 4]
    assert simhash.wide_shape(1 << 24) == (8, 12) and simhash.wide_shape(1 << 26)[1] == 14
    for n in (1 << 25, 1 << 28, 1 << 30):
        words, band = simhash.wide_shape(n)
        assert (1 - simhash.WIDE_EQUAL**band) ** (words * (64 // band)) <= simhash.WIDE_MISSED


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, 100 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {100 + k: 100 for k in range(1, 200)}


def test_alike_texts_are_dropped(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice(EN) + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(12)]
    rows, k = [], 0
    for text in base:
        rows.append((k, text))
        for change in (1, 2, 4):  # five-word shingles then agree to 0.97, 0.94 and 0.87
            words = text.split()
            for at in rng.sample(range(10, 290), change):
                words[at] = "changed"
            rows.append((k + change, " ".join(words)))
        k += 10
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_alike(table).collect()) == [10 * i for i in range(12)]


def test_one_row_stays_of_each_component_whatever_its_id(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(rng.choice(EN) + str(rng.randint(0, 99)) for _ in range(200)) for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (1, e), (2, d), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for drop in (simhash.drop_near_duplicates, simhash.drop_alike):
        got = Counter((r.doc_id, r.text or "") for r in drop(table).collect())
        assert got == Counter([(None, a), (None, b), (1, c), (2, d), (1, e), (None, "")])


def changed_at_end(words, likeness):
    """A text whose five-word shingles agree with those of ``words`` to about ``likeness``, and the exact figure."""
    n = len(words) - 4
    cut = round(n * (1 - likeness) / (1 + likeness))
    other = words[: len(words) - cut] + [f"new{k}" for k in range(cut)]
    a, b = ({tuple(w[k : k + 5]) for k in range(n)} for w in (words, other))
    return " ".join(other), len(a & b) / len(a | b)


def test_alike_means_four_fifths_of_shingles(spark):
    rng = random.Random(13)
    rows, want = [], set()
    for k in range(120):
        words = [rng.choice(EN) + str(rng.randint(0, 99)) for _ in range(400)]
        other, likeness = changed_at_end(words, rng.uniform(0.802, 0.82) if k % 2 else rng.uniform(0.70, 0.78))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, other)]
        want |= {2 * k} if likeness >= 0.8 else {2 * k, 2 * k + 1}
    left = {r.doc_id for r in simhash.drop_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= left  # no text goes that is alike to less
    assert len(left - want) <= 2  # of 60 copies


def test_alike_pairs_of_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(14)
    base = [rng.choice(EN) + str(rng.randint(0, 99)) for _ in range(120)]
    texts = [None, " ", " ".join(base)]
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = str(rng.random())
        texts.append(" ".join(words))
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    pairs = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    found = simhash.alike_pairs([simhash.shingles(t or "", 5) for t in texts])
    assert set(zip(*(x.tolist() for x in found), strict=True)) == pairs
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = table.select("doc_id", simhash._text_key("text").alias("_key"), F.lit(1).cast("long").alias("_root"))
    ids = {r._key: r.doc_id for r in keys.collect()}
    stars = simhash.components(simhash.alike_links(table, keys.select("_key", "_root"), "text")).collect()
    got, plain = {ids[r.node]: ids[r.root] for r in stars}, list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            plain[i] = plain[j] = min(plain[i], plain[j])
    groups = lambda label: sorted(sorted(k for k in range(len(texts)) if label(k) == x) for x in {label(k) for k in range(len(texts))})
    assert groups(lambda k: got.get(k, k)) == groups(lambda k: plain[k])


# ---- 7


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r[0])
    want, stay = Counter(), Counter()
    for r in ROWS:
        ids = [i for i in groups[norm(r[1])] if i is not None]
        keep = min(ids, default=None)
        kept = r[0] == keep and not stay[(keep, norm(r[1]))]
        stay[(keep, norm(r[1]))] += kept
        want[(r[0], keep, len(groups[norm(r[1])]), bool(kept), sha(norm(r[1])))] += 1
    for most in (membership.MOST, 1 << 15):
        got = exact_dedup.duplicate_groups(docs, digest=True, most=most).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(k[0] for k, n in want.items() if k[3] for _ in range(n))
    assert exact_dedup.duplicate_groups(empty, digest=True).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


# ---- 8


@pytest.mark.parametrize("sequence", [16, 2048])
def test_token_files(spark, docs, empty, sequence):
    library = Tokenizer.from_file(BYTE_BPE)
    manifest = token_files.write_token_files(docs, storage.work_path(spark, "test-files"), BYTE_BPE, sequence=sequence)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    at = 0
    for r, g in zip(ordered, got, strict=True):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for m in manifest.collect():
        whole = [x for x in token_files.sequences(m.file)]
        ids, mask = (np.concatenate(x) for x in zip(*whole, strict=True))
        assert mask.sum() == m.n_tokens and mask.reshape(-1)[: m.n_tokens].all() and ids.shape[1] == sequence
        one, its_mask = token_files.sequence_at(m.file, len(ids) - 1)
        assert (one == ids[-1]).all() and (its_mask == mask[-1]).all()
    assert token_files.read_documents(token_files.write_token_files(empty, storage.work_path(spark, "test-files"), BYTE_BPE)).count() == 0


# ---- 9

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark, docs, empty):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", ".", "x-y", "1", "12", "4111 1111 1111 1111", "378282246310005", "+", "+1 ", "(020)", " ", "-", "255", "256", "007", "_", "é", "😀", "10.1.2.3", "+44 20 7946 0958", "m@n.org"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(1500)]
    rows += [(2000, "a" * 20_000), (2001, "1" * 20_000), (2002, "a@b" + ".c" * 5000), (2003, "1 " * 9000), (2004, "+1" + "-" * 9000), (2005, "a@" * 5000)]
    for table, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)), (docs, {r[0]: r[1] for r in ROWS})):
        for r in sanitise.report(table).collect():
            spans = plain_spans(texts[r.doc_id] or "")
            base = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)
            assert r.base_sha256 == sha(base), (texts[r.doc_id], r.spans, base)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
    assert sanitise.report(empty).count() == 0


# ---- the pipeline


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, docs):
    where = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    prose = [(500 + k, " ".join(EN[(k * 7 + j * j) % len(EN)] + rng.choice(["", "s", "ed"]) for j in range(60 + k % 50)) + ".", "en", f"s{k % 3}") for k in range(120)]
    junk = [(700 + k, " ".join(w.upper() + "!!" for w in rng.choices(EN, k=50)), "en", "s1") for k in range(40)]
    rows = prose + junk + [(900, prose[3][1], "en", "s0"), (901, prose[4][1].replace(" ", "  ", 3), "en", "s2")]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(k, 1, 0) for k, *_ in prose[:90]] + [(k, 0, 0) for k, *_ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["quality", "exact", "SimHash", "mixing", "BPE"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.keep(stage(spark, docs, sf), "test-stage")
        seen[name.split()[0]] = docs
        assert name == names[-1] or docs.columns == columns
    ids = {k: Counter(r.doc_id for r in df.select("doc_id").collect()) for k, df in seen.items()}
    assert not any(700 <= k < 800 for k in ids["quality"]) and len(ids["quality"]) >= 115
    assert set(ids["exact"]) == set(ids["quality"]) - {900, 901}
    assert set(ids["SimHash"]) <= set(ids["exact"]) and all(n == 1 for n in ids["SimHash"].values())
    drawn = {r._id: r.copies for r in mixing.with_copies(seen["SimHash"], carry=[]).collect()}
    assert ids["mixing"] == Counter({k: n for k, n in drawn.items() if n}) and ids["BPE"] == ids["mixing"]
    library = Tokenizer.from_file(BYTE_BPE)
    texts = {r.doc_id: r.text for r in seen["SimHash"].collect()}
    for r in docs.collect():
        tokens = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(tokens), sha(",".join(map(str, tokens))), sha(texts[r.doc_id]))
    again = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, docs.collect()))


def test_stages_take_empty_tables(spark, sf, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_queries_are_named_by_operator():
    assert [next(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith(f"op{k}_")) for k in range(1, 11)] == list(range(1, 11))
