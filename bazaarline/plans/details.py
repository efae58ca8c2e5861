"""Entries of the inventory that are parts or summaries of others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import cents, clamp, js_round, ladder
from ..functions.text import word
from ..operators import scores, signature
from ..operators import sequences as seq
from ..sources import pages
from .base import QUERIES, c, query, r2, table


@query(
    "ag_33_diagnostic_report",
    """WITH p AS (SELECT page_id, length(html) AS n, CASE WHEN length(html) < 1500 THEN 'critical' WHEN length(html) < 4000 THEN 'weak' ELSE 'healthy' END AS bucket FROM pages)
       SELECT bucket, count(*) AS pages, list_slice(list(page_id ORDER BY n, page_id), 1, 5) AS worst FROM p GROUP BY 1""",
)
def _(spark, d):
    bucket = ladder(F.length("html"), [("<", 1500, "critical"), ("<", 4000, "weak")], "healthy")
    rows = table(spark, d, "pages").select("page_id", F.length("html").alias("n"), bucket.alias("bucket"))
    worst = rows.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("n", "page_id"))).where("k <= 5")
    lists = worst.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "page_id"))), lambda s: s["page_id"]).alias("worst"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("pages")).join(lists, "bucket")


@query("ag_40_verdict_counts", "WITH v AS (SELECT CASE WHEN o_totalprice > 200000 THEN 'skip' WHEN o_totalprice > 100000 THEN 'wait' ELSE 'buy' END AS verdict FROM orders) SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def _(spark, d):
    verdict = ladder(F.col("o_totalprice"), [(">", 200_000, "skip"), (">", 100_000, "wait")], "buy")
    return table(spark, d, "orders").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ag_42_portfolio_dashboard",
    f"""WITH t AS (SELECT o_custkey, CAST(sum({c('o_totalprice')}) AS BIGINT) AS total_cents, list_slice(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), 1, 10) AS latest FROM orders GROUP BY 1)
        SELECT o_custkey, total_cents, latest, CASE WHEN total_cents >= 200000000 THEN 4 WHEN total_cents >= 100000000 THEN 3 WHEN total_cents >= 50000000 THEN 2 ELSE 1 END AS tier FROM t""",
)
def _(spark, d):
    last = seq.keep_last(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], 10)
    lists = last.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")), asc=False), lambda s: s["o_orderkey"]).alias("latest"))
    totals = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents(F.col("o_totalprice"))).alias("total_cents"))
    tier = ladder(F.col("total_cents"), [(">=", 200_000_000, 4), (">=", 100_000_000, 3), (">=", 50_000_000, 2)], 1)
    return totals.join(lists, "o_custkey").withColumn("tier", tier)


@query("sc_08_reference_prices", f"SELECT l_orderkey, l_linenumber, {r2('coalesce(CASE WHEN p_size > 30 THEN p_retailprice END, CASE WHEN p_size > 10 THEN p_retailprice * 0.9 END, p_retailprice * 0.8)')} AS reference FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, d):
    p, size = F.col("p_retailprice"), F.col("p_size")
    price = F.coalesce(F.when(size > 30, p), F.when(size > 10, p * 0.9), p * 0.8)
    reference = table(spark, d, "part").select("p_partkey", js_round(price, 2).alias("reference"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(reference, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "reference")


@query("sc_15_model_verdicts", "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'false' WHEN quality = 1 AND toxic = 0 THEN 'true' ELSE 'uncertain' END AS verdict FROM labels")
def _(spark, d):
    answer = lambda yes, no: F.when(no, "false").when(yes, "true").otherwise("uncertain")
    verdict, _ = scores.vision_verdict(answer(F.col("quality") == 1, F.col("quality") == 0), answer(F.col("toxic") == 0, F.col("toxic") == 1), F.lit(True), F.lit(None).cast("double"))
    return table(spark, d, "labels").select("doc_id", verdict.alias("verdict"))


@query(
    "fs_05_set_code",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'YAP' || (p_size % 10) WHEN 1 THEN 'OP' || lpad(CAST(p_size AS VARCHAR), 2, '0') WHEN 2 THEN 'sv' || p_size ELSE NULL END AS code FROM part""",
)
def _(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    written = F.when(k == 0, F.concat(F.lit("Card yap"), (F.col("p_size") % 10).cast("string"), F.lit("-jp006"))).when(k == 1, F.concat(F.lit("Luffy OP"), F.lpad(size, 2, "0"), F.lit("-025"))).when(k == 2, F.concat(F.lit("Pika SV"), size)).otherwise("plain title")
    return table(spark, d, "part").select("p_partkey", signature.set_code(written).alias("code"))


@query("fs_13_simple_price", f"SELECT p_partkey, {r2('p_retailprice')} AS price FROM part")
def _(spark, d):
    written = F.concat(F.replace(F.format_string("%.2f", js_round(F.col("p_retailprice"), 2)), F.lit("."), F.lit(",")), F.lit(" €"))
    return table(spark, d, "part").select("p_partkey", F.replace(F.regexp_extract(written, "([0-9]+,[0-9]{2})", 1), F.lit(","), F.lit(".")).try_cast("double").alias("price"))


@query("fm_02_piecewise_speed", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0.5 THEN 100.0 WHEN l_quantity <= 2 THEN 85 + (2 - l_quantity) * 10 WHEN l_quantity <= 7 THEN 55 + (7 - l_quantity) / 5 * 30 WHEN l_quantity <= 14 THEN 25 + (14 - l_quantity) / 7 * 30 WHEN l_quantity <= 30 THEN 5 + (30 - l_quantity) / 16 * 20 WHEN l_quantity <= 60 THEN (60 - l_quantity) / 30 * 5 ELSE 0 END AS speed FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.agent_speed(F.col("l_quantity")).alias("speed"))


@query("fm_03_steps", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 0 THEN 0 WHEN l_quantity <= 2 THEN 15 WHEN l_quantity <= 5 THEN 30 WHEN l_quantity <= 10 THEN 60 WHEN l_quantity <= 20 THEN 80 ELSE 100 END AS volume, CASE WHEN l_linenumber >= 3 THEN CASE WHEN l_discount * 10 >= 0.7 THEN 100 WHEN l_discount * 10 >= 0.5 THEN 80 WHEN l_discount * 10 >= 0.3 THEN 60 WHEN l_discount * 10 >= 0.1 THEN 40 ELSE 20 END ELSE 50 END AS turnover FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.volume_step(F.col("l_quantity")).alias("volume"), scores.turnover_step(F.col("l_discount") * 10, F.col("l_linenumber")).alias("turnover"))


@query("fm_08_keyword_multiplier", "SELECT p_partkey, CAST((CASE WHEN contains(p_name, 'red') THEN 1.5 WHEN contains(p_name, 'blue') THEN 1.25 ELSE 1.0 END) * (CASE WHEN contains(p_name, 'ring') THEN 2.0 WHEN contains(p_name, 'bolt') THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS multiplier FROM part")
def _(spark, d):
    """Per category the greatest multiplier of the keywords present, multiplied over categories."""
    categories = [{"red": 1.5, "blue": 1.25}, {"ring": 2.0, "bolt": 0.5}]
    factors = [F.coalesce(F.array_max(F.array(*[F.when(F.col("p_name").contains(k), v) for k, v in words.items()])), F.lit(1.0)) for words in categories]
    return table(spark, d, "part").select("p_partkey", (factors[0] * factors[1]).alias("multiplier"))


@query("fj_01_embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"page":'), "props", F.lit("}}</script></html>"))
    return table(spark, d, "events").select("event_id", F.get_json_object(pages.embedded_json(page), "$.props.page.k").cast("long").alias("k"))


@query(
    "dm_21_suggestions",
    f"""WITH g AS (SELECT p_type AS category, count(*) AS n, CAST(sum({c('p_retailprice')}) AS DOUBLE) / count(*) / 100 AS price FROM part GROUP BY 1)
        SELECT 'new_category' AS kind, category AS name FROM g WHERE price > 1300 UNION ALL SELECT 'underperforming', category FROM g WHERE n < 200 UNION ALL SELECT 'keyword', w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w HAVING count(*) > 250""",
)
def _(spark, d):
    from ..functions.numbers import mean_cents

    part = table(spark, d, "part")
    g = part.groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), mean_cents(F.col("p_retailprice")).alias("price"))
    words = part.select(F.explode(F.split("p_name", " ")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 250")
    kinds = {"new_category": g.where("price > 1300"), "underperforming": g.where("n < 200"), "keyword": words}
    out = [df.select(F.lit(kind).alias("kind"), "name") for kind, df in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("dm_26_rule_counts", "SELECT count(*) FILTER (regexp_matches(lower(text), '\\b(psa|bgs)\\b')) AS graded, count(*) FILTER (regexp_matches(lower(text), '\\b(lot|bundle)\\b')) AS lot, count(*) FILTER (regexp_matches(lower(text), '\\b(gold|or)\\b')) AS gold FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def _(spark, d):
    rejected = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t")).join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    rules = {"graded": "psa|bgs", "lot": "lot|bundle", "gold": "gold|or"}
    return rejected.agg(*[F.count_if(F.col("t").rlike(word(p))).alias(k) for k, p in rules.items()])


@query("dm_32_batch_transition", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'active' WHEN event_type = 'click' THEN 'candidate' ELSE 'rejected' END AS status, least(greatest(value / 5, 20), 100) AS confidence FROM events")
def _(spark, d):
    t = F.col("event_type")
    verdict = F.when(t == "purchase", "true").when(t == "click", "uncertain").otherwise("false")
    status = F.when(verdict == "true", "active").when(verdict == "uncertain", "candidate").otherwise("rejected")
    return table(spark, d, "events").select("event_id", status.alias("status"), clamp(F.col("value") / 5, 20.0, 100.0).alias("confidence"))


@query("pf_08_failing_criteria", "SELECT l_orderkey, l_linenumber, len(list_filter([l_extendedprice * l_discount / 100 < 15, l_discount * 500 < 20, l_quantity * 2 < 30, l_tax * 1000 < 30, l_linenumber < 2], lambda x: x)) AS failing FROM lineitem")
def _(spark, d):
    evaluated = QUERIES["dm_08_evaluate"](spark, d)
    return evaluated.select("l_orderkey", "l_linenumber", F.size(F.filter(F.split("failing", ","), lambda x: x != "")).cast("long").alias("failing"))
