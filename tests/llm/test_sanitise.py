"""Disclosing terms against a plain count over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bazaarline.llm import sanitise

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[ -]?[0-9]){11,}", r"\+[0-9][\x20().0-9-]+[0-9]"]
WORD = r"[^\W_]{2,}"


def corpus():
    rng = random.Random(3)
    filler = [f"word{k}" for k in range(30)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [f"Zanzibar {k} dossier {some(4)} jo.doe@corp.example {some(300)} the DOSSIER of Jo, doe & 42 zanzibar" for k in range(6)]
    rows += [f"letter {some(20)} ann{k}@corp.example {some(3)} Müller" for k in range(30)]
    rows += [f"host lab {some(5)} 10.20.30.{k} {some(5)}" for k in range(9)]
    rows += [f"call +44 20 7946 {1000 + k} {some(6)} desk" for k in range(4)]
    rows += [f"once {some(5)} single@rare.example {some(5)} hapax"]
    rows += [some(25) + (" zanzibar" if k == 0 else "") for k in range(150)]
    rows += [rows[0], rows[0], rows[7], "", None]
    return list(enumerate(rows))


ROWS = corpus()


def base(text):
    return [(m.start(), m.end(), k, m[0]) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text)]


def protected(spans):
    out = set()
    for _, _, k, v in spans:
        digits, v = re.sub(r"\D", "", v), v.lower()
        out.add(("email", "ip", "card", "phone")[k])
        if k == 0:
            name, domain = v.rsplit("@", 1)
            out |= {f"email:{v}", f"domain:{domain}", *(f"name:{x}" for x in re.split("[._%+-]+", name) if len(x) >= 2)}
        out |= [set(), {f"ip:{v}", "net:" + ".".join(v.split(".")[:3])}, {f"card:{digits}", f"issuer:{digits[:6]}"}, {f"phone:{digits}", f"exchange:{digits[:-4]}"}][k]
    return out


def plain_rules():
    texts = Counter(t or "" for _, t in ROWS)
    n = sum(texts.values())
    words, entities = {}, {}
    for t in texts:
        spans = base(t)
        entities[t] = protected(spans)
        outside = "".join(" " if any(a <= k < b for a, b, *_ in spans) else c for k, c in enumerate(t))
        words[t] = set(re.findall(WORD, outside.lower()))
    n_t = Counter(w for t, c in texts.items() for w in set(re.findall(WORD, t.lower())) for _ in range(c))
    n_e = Counter(e for t, c in texts.items() for e in entities[t] for _ in range(c))
    n_te, seen = Counter(), Counter()
    for t, c in texts.items():
        for e in entities[t]:
            for w in words[t]:
                n_te[e, w] += c
                seen[e, w] += 1
    rules = {}
    for (e, w), k in n_te.items():
        p, z = k / n_t[w], 1.64
        m = seen[e, w] / p
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        ic = math.log2(n / n_e[e])
        if low >= 0.5 and ic > 0 and (math.log2(low) + ic) / ic >= sanitise.GENERALISE:
            rules[e, w] = "remove" if (math.log2(low) + ic) / ic >= sanitise.REMOVE else "generalise"
    return rules


def plain_terms(text, rules):
    spans = base(text)
    told = {}
    for e in protected(spans):
        for (x, w), action in rules.items():
            if x == e:
                told[w] = max(told.get(w, ""), action)
    found = [(m.start(), m.end(), told[m[0].lower()]) for m in re.finditer(WORD, text) if m[0].lower() in told]
    return [f for f in found if not any(a < f[1] and f[0] < b for a, b, *_ in spans)]


def test_terms_by_brute_force(spark):
    rules = plain_rules()
    assert {("email:jo.doe@corp.example", w) for w in ("zanzibar", "dossier", "doe", "42", "jo")} <= set(rules)
    assert {("domain:corp.example", "letter"), ("net:10.20.30", "lab"), ("exchange:44207946", "desk")} <= set(rules)
    assert not any(w == "hapax" for _, w in rules)
    table = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("_n", F.lit("clash")).repartition(3)
    found = sanitise.find(table).collect()
    assert Counter((r._id, tuple((s.start, s.end, s.value) for s in r._terms)) for r in found) == Counter((k, tuple(plain_terms(t or "", rules))) for k, t in ROWS)
    assert sum(len(r._terms) for r in found) > 100
    report = {r.doc_id: r.spans for r in sanitise.report(table).collect()}
    assert all(not report[k] for k, t in ROWS if not base(t or ""))
    assert report[0].count("term:") == len(plain_terms(ROWS[0][1], rules))


def test_sanitised_texts(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("_told", F.lit("clash"))
    got = {r.doc_id: r for r in sanitise.sanitise(table).collect()}
    assert "jo.doe@corp" not in got[0].sanitised and "zanzibar" not in got[0].sanitised.lower() and "dossier" not in got[0].sanitised.lower()
    assert "[EMAIL]" in got[0].sanitised and got[0]._told == "clash"
    clean = next(k for k, t in ROWS if t and "zanzibar" in t and "@" not in t)
    assert got[clean].sanitised == ROWS[clean][1]


def test_positions_when_lower_case_is_longer(spark):
    rows = [(k, f"İİİ {k} Zanzibar jo@corp.example ending{k} İ") for k in range(5)] + [(10 + k, f"other text {k}") for k in range(40)]
    got = sanitise.find(spark.createDataFrame(rows, "doc_id long, text string")).where("_id = 0").first()
    text = rows[0][1]
    assert "Zanzibar" in {text[s.start : s.end] for s in got._terms}


@pytest.mark.parametrize("n_te, n_t, texts", [(3, 3, 3), (10, 12, 4), (1, 1, 1), (50, 100, 50)])
def test_likely_is_the_wilson_bound(spark, n_te, n_t, texts):
    p, z = n_te / n_t, sanitise.DEVIATIONS
    m = texts / p
    want = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    got = spark.range(1).select(sanitise.likely(F.lit(n_te), F.lit(n_t), F.lit(texts)).alias("p")).first().p
    assert got == pytest.approx(want) and (want < sanitise.LIKELY or texts >= sanitise.LEAST_TEXTS)


def test_many_hits_in_one_text(spark):
    """160,000 addresses in one text, and 100,000 occurrences of a disclosing term in another: linear time."""
    import time

    n, m = 160_000, 100_000
    mails = " ".join(f"user{k}@host{k % 7}.example.org é" for k in range(n))
    docs = spark.createDataFrame([(1, mails)] + [(k, f"zorblat {k} a@b.example {'zorblat ' * (m if k == 10 else 1)}" + f"x{k}") for k in range(10, 18)] + [(k, f"nothing here {k}") for k in range(100, 140)], "doc_id long, text string")
    sanitise.report(docs.where("doc_id > 100")).collect()
    began = time.time()
    got = {r.doc_id: r for r in sanitise.report(docs).collect()}
    took = time.time() - began
    assert got[1].n_email == n
    spans = got[1].spans.split(",")
    assert len(spans) == n
    for s in (spans[0], spans[77_777], spans[-1]):
        kind, a, b = s.split(":")
        assert kind == "email" and mails[int(a) : int(b)].startswith("user") and mails[int(a) : int(b)].endswith(".org")
    assert got[10].spans.count("term:") == m + 1
    assert took < 200  # by squares of the hits it took an hour
    began = time.time()
    clean = {r.doc_id: r.sanitised for r in sanitise.sanitise(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL] é"] * n) and "zorblat" not in clean[10] and clean[100] == "nothing here 100"
    assert time.time() - began < 300
