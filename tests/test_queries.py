"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import bazaarline.registry as registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(names, records):
    return sorted(repr(tuple(plain(r[n]) for n in names)) for r in records)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [r.asDict(recursive=True) for r in df.collect()]
    if name not in registry.ORACLES:
        return
    result = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    assert rows(sorted(names), got) == rows(sorted(names), want)


def test_nested_ads_cases(spark):
    from bazaarline.sources import pages

    ad = '[{"subject":"a","price":1}]'
    texts = [
        ad,
        '{"x":' + ad + "}",
        '{"data":' + ad + ',"results":[{"subject":"b","price":2}]}',
        '[1,2,3,4,5,{"ads":' + ad + "}]",
        '{"ads":[{"subject":"","price":1}],"data":[[' + ad + "]]}",
        '{"data":' * 9 + ad + "}" * 9,
        "no json",
        None,
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["ads"] for r in pages.find_ads(rows, "k", "t").collect()}
    second = got[2].replace(" ", "")
    assert '"b"' in second and sorted(got) == [0, 2, 4]


def test_nested_ads_in_linear_time(spark):
    """Five children a level over eight levels, 390,625 leaves; listings in the last one, and deeper still."""
    import json
    import time

    from bazaarline.sources import pages

    def tree(depth, last):
        return last if depth == 0 else [tree(depth - 1, None) if k < 4 else tree(depth - 1, last) for k in range(5)]

    def bare(depth):
        return [] if depth == 0 else [bare(depth - 1)] * 5

    ad = [{"subject": "s", "price": 2}]
    texts = [json.dumps(tree(8, ad)), json.dumps([tree(8, ad)]), json.dumps(bare(8)), json.dumps({"x": ad, "items": [0, 0, 0, 0, {"ads": [[], ad]}]})]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    began = time.time()
    got = {r["k"]: json.loads(r["ads"]) for r in pages.find_ads(rows, "k", "t").collect()}
    assert got == {0: ad, 3: ad} and time.time() - began < 200


def test_peers_cases(spark):
    from bazaarline.operators import peers

    schema = "g string, id long, price double, v array<float>"
    same = [1.0, 0.0]
    rows = [("a", 1, 1.0, same), ("a", 2, 4.0, same), ("a", 3, 6.0, same), ("a", 4, 9.0, [0.0, 1.0]), ("b", 5, 1.0, same), ("b", 6, 9.0, same), (None, 7, 1.0, same), (None, 8, 2.0, same), (None, 9, 2.0, same), (None, 10, 5.0, same), ("a", 11, None, same), ("a", 12, 3.0, None), ("a", 13, 3.0, [0.0, 0.0])]
    got = peers.cheap_against_rest(spark.createDataFrame(rows, schema), "g", "id", "price", "v", 0.6).collect()
    assert sorted(map(tuple, got)) == [(1, 1.0, 2, 6.0, 5.0), (7, 1.0, 3, 2.0, 3.0)]
    assert peers.cheap_against_rest(spark.createDataFrame([], schema), "g", "id", "price", "v", 0.6).collect() == []


def test_peers_of_clustered_vectors(spark, monkeypatch):
    """The rows of all products of blocks, from a tenth of the pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from bazaarline.operators import peers

    monkeypatch.setattr(peers, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = [(k % 10 == 0 and "b" or "a", k, float(rng.integers(1, 60)), (centres[k % 60] + rng.normal(scale=0.04, size=24)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, id long, price double, v array<float>").repartition(4)
    got = sorted((r.id, r.peers, r.median) for r in peers.cheap_against_rest(df, "g", "id", "price", "v", 0.9).collect())
    units = np.array([r[3] for r in rows], np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want, every = [], 0
    for g in "ab":
        own = sorted((r[2], r[1]) for r in rows if r[0] == g)
        cheap, rest = own[: -(-len(own) // 4)], own[-(-len(own) // 4) :]
        every += len(cheap) * len(rest)
        alike = units[[i for _, i in cheap]] @ units[[i for _, i in rest]].T >= 0.9
        for (_, i), hit in zip(cheap, alike, strict=True):
            prices = sorted(p for (p, _), h in zip(rest, hit, strict=True) if h)
            if len(prices) >= 2:
                want.append((i, len(prices), prices[len(prices) // 2]))
    assert got == sorted(want) and len(want) > 900
    placed = peers.placed_rows(df, "g", "id", "price", "v")
    blocks = peers._blocks(placed, peers._anchors(placed))
    compared = peers.block_pairs(blocks, 0.9).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert compared < 0.1 * every
