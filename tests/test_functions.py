"""Hand-worked values and properties of functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from bazaarline.functions import dates, numbers, text
from bazaarline.operators import dedup, merge, scores
from bazaarline.operators import sequences as seq
from bazaarline.sources import logs, pages


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_js_round(spark):
    values = [-2.5, -0.5, 0.5, 1.005, 2.675, -1.235, 1e9 + 0.5]
    got = one(spark, *[numbers.js_round(F.lit(v), 2) for v in values])
    assert got == tuple(math.floor(v * 100 + 0.5) / 100 for v in values)
    assert one(spark, numbers.js_round(F.lit(-2.5))) == (-2.0,)


@pytest.mark.parametrize(
    "raw, value", [("1.234,56 €", 1234.56), ("£12.99", 12.99), ("1,234", 1234.0), ("EUR 5", 5.0), ("3,5", 3.5), ("12 345,60", 12345.6), ("none", None), (None, None)]
)
def test_euro_amount(spark, raw, value):
    assert one(spark, text.euro_amount(F.lit(raw).cast("string"))) == (value,)


@pytest.mark.parametrize("raw, day", [("Vendu le 12 mars 2024", "2024-03-12"), ("Sold Mar 5, 2024", "2024-03-05"), ("verkauft 1. Februar 2023", "2023-02-01"), ("31 de diciembre de 2022", "2022-12-31"), ("31 feb 2022", None), ("soon", None), (None, None)])
def test_localised_date(spark, raw, day):
    got = one(spark, dates.localised_date(F.lit(raw).cast("string")).cast("string"))[0]
    assert got == day


def test_ascii_word_border(spark):
    assert one(spark, F.lit("un signé là").rlike(text.word("sign")), F.lit("design").rlike(text.word("sign"))) == (True, False)


def test_medians(spark):
    for values, mid, upper in (([1.0], 1.0, 1.0), ([1.0, 2.0], 1.5, 2.0), ([3.0, 1.0, 2.0], 2.0, 2.0), ([4.0, 1.0, 2.0, 3.0], 2.5, 3.0)):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert tuple(df.agg(numbers.median_mid(F.col("x")), numbers.median_upper("x")).first()) == (mid, upper)


@pytest.mark.parametrize("n, step", [(0, 0), (1, 15), (2, 15), (3, 30), (5, 30), (6, 60), (10, 60), (11, 80), (20, 80), (21, 100)])
def test_volume_step(spark, n, step):
    assert one(spark, scores.volume_step(F.lit(n))) == (step,)


@pytest.mark.parametrize("cv, step", [(None, 50), (0.05, 100), (0.1, 80), (0.2, 60), (0.3, 40), (0.5, 20)])
def test_stability_step(spark, cv, step):
    assert one(spark, scores.stability_step(F.lit(cv).cast("double"))) == (step,)


def test_vision_ends_or_caps_confidence(spark):
    def score(text_points, source, vision, verdict, comparable=True, used=False, penalty=0, seller=50, n=3, niche=False):
        args = [F.lit(x) for x in (text_points, source, vision)] + [F.lit(verdict).cast("string")] + [F.lit(x) for x in (comparable, used, penalty, seller, n, niche)]
        return one(spark, scores.confidence(*args))[0]

    assert score(40, 20, 50, "true") == 100
    assert score(40, 20, 50, "false") == 0
    assert score(40, 20, 0, None) == 59  # no strong signal
    assert score(40, 20, 50, "true", seller=10) == 40
    assert score(40, 20, 50, "true", n=1) == 45
    assert score(40, 20, 50, "true", penalty=-30) == 70
    assert score(40, 20, 41, "true", comparable=False, used=True) == 70


def test_image_match_caps(spark):
    s = lambda x: F.lit(x).cast("string")
    alike = scores.image_match(F.lit(1.0), (s("gold"), s("gold")), (s("25"), s("25")), (s(None), s(None)), F.lit(1.0))
    border = scores.image_match(F.lit(1.0), (s("gold"), s("blue")), (s(None), s(None)), (s(None), s(None)), F.lit(1.0))
    number = scores.image_match(F.lit(1.0), (s("gold"), s("gold")), (s("25"), s("26")), (s(None), s(None)), F.lit(1.0))
    assert one(spark, alike, border, number) == pytest.approx((1.0, 0.35, 0.20))


def test_streaks(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate("fffsffn")], "key string, seq int, state string")
    got = seq.running_streak(df, "key", ["seq"], F.col("state") == "f", F.col("state") == "s").orderBy("seq").collect()
    assert [r.streak for r in got] == [1, 2, 3, 0, 1, 2, 2]
    assert seq.zero_streak(df, "key", ["seq"], F.col("state") != "s").first().streak == 3


def test_dedup_is_idempotent_and_interleave_has_no_repeats(spark):
    rows = [(k % 5, f"u{k % 7}", f"A long enough title {k % 4}", float(k % 3), k) for k in range(40)]
    df = spark.createDataFrame(rows, "grp int, url string, title string, price double, seq int")
    once = dedup.by_url_then_title(df, "url", "title", "price", "seq")
    assert sorted(map(tuple, dedup.by_url_then_title(once, "url", "title", "price", "seq").collect())) == sorted(map(tuple, once.collect()))
    pools = dedup.pools(df.withColumn("spec", F.col("seq") % 6), "grp", "spec", "price", "seq", 4)
    mixed = dedup.interleave(pools, "grp", "place", "pool_no", "url", 10)
    assert mixed.groupBy("grp", "url").count().where("count > 1").count() == 0


def test_merge_is_idempotent_on_the_same_snapshot(spark):
    snap = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "url string, first int, last int")
    old = spark.createDataFrame([("a", 0, 1), ("c", 0, 2)], "url string, first int, last int")
    merged = merge.merge_history(snap, old, "url", "first", "last", F.lit(True))
    assert sorted(map(tuple, merged.collect())) == [("a", 0, 5, False), ("b", 2, 6, False), ("c", 0, 2, True)]
    again = merge.merge_history(snap, merged.drop("stale"), "url", "first", "last", F.lit(True))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_embedded_json_comes_before_tags(spark):
    page = '<script id="__NEXT_DATA__" type="x">{"props":{"items":[{"title":"T","link":"/1","price":2.5}]}}</script><a href="/2">two</a>'
    df = spark.createDataFrame([("u1", page), ("u2", '<a class="x" href="/2">two</a>')], "url string, html string")
    got = pages.scan_listings(df, "$.props.items", "title: string, link: string, price: double").orderBy("url").collect()
    assert [(r.url, r.strategy, r.title, r.link, r.price) for r in got] == [("u1", "json", "T", "/1", 2.5), ("u2", "tags", "two", "/2", None)]


def test_log_skips_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(spark.createDataFrame([("a", "b", "x")], "`from` string, `to` string, type string"), path)
    (tmp_path / "log" / "more.json").write_text('{"from":"c","to":"d","type":"y"}\n{broken\n')
    assert sorted(r["from"] for r in logs.read_log(spark, path).collect()) == ["a", "c"]


def test_min_price_is_pushed_down(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("p_retailprice"), "id").write.parquet(str(tmp_path / "part.parquet"))
    plan = spark.read.parquet(str(tmp_path / "part.parquet")).where("p_retailprice >= 2")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_retailprice,2.0)" in plan


def test_jaccard(spark):
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == (0.5,)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == (0.0,)


def test_snapshots_of_both_layouts(spark, tmp_path):
    from bazaarline.sources import logs

    (tmp_path / "rows.json").write_text('[{"id": 1, "name": "a"}, {"id": 2, "name": null}]')
    (tmp_path / "items.json").write_text('{"items": [{"id": 3, "name": "c"}, {"id": 4}]}')
    read = lambda path, **how: sorted((r.id, r.name) for r in logs.read_snapshot(spark, str(path), "id long, name string", **how).collect())
    assert read(tmp_path / "rows.json") == [(1, "a"), (2, None)] and read(tmp_path / "items.json") == [(3, "c"), (4, None)]
    assert read(tmp_path / "none.json") == []
    assert read(tmp_path / "none.json", default=spark.createDataFrame([(9, "z")], "id long, name string")) == [(9, "z")]
    for rows in ([(4, "d")], [(5, "e"), (6, "f")]):
        logs.write_snapshot(spark.createDataFrame(rows, "id long, name string").coalesce(1), str(tmp_path / "new"))
    assert sorted(map(tuple, logs.read_log(spark, str(tmp_path / "new"), "id long, name string").collect())) == rows


def test_upper_median_and_quantiles(spark):
    from bazaarline.functions.numbers import at_quantile, median_upper

    rows = [(n, float(x)) for n in range(1, 12) for x in range(n)] + [(1, None), (99, None)]
    got = spark.createDataFrame(rows, "k int, x double").groupBy("k").agg(median_upper("x").alias("m"), at_quantile("x", 0.25).alias("q"), at_quantile("x", 0.75).alias("p")).collect()
    assert {r.k: (r.m, r.q, r.p) for r in got} == {n: (float(n // 2), float(int(n * 0.25)), float(int(n * 0.75))) for n in range(1, 12)} | {99: (None, None, None)}
