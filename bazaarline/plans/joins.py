"""Joins JN-01 to JN-16 that the merge queries don't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import js_round
from ..functions.text import slug_tokens
from ..operators import matching, peers
from .base import query, r2, table


@query("jn_02_group_comparables", f"SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS n, {r2('l_extendedprice - min(l_extendedprice) OVER (PARTITION BY l_partkey)')} AS above_least FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.count(F.lit(1)).over(w).alias("n"), js_round(F.col("l_extendedprice") - F.min("l_extendedprice").over(w), 2).alias("above_least"))


@query(
    "jn_05_catalogue_best",
    """WITH c AS (SELECT p_name, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, min(p_retailprice) AS price FROM part GROUP BY p_name),
       m AS (SELECT n.p_name AS name, c.p_partkey, price, len(list_intersect(string_split(n.p_name, ' '), string_split(c.p_name, ' '))) AS shared FROM (SELECT DISTINCT p_name FROM part) n CROSS JOIN c),
       best AS (SELECT * FROM m WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY shared DESC, price, p_partkey) = 1)
       SELECT l_orderkey, l_linenumber, best.p_partkey, shared FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN best ON best.name = p.p_name""",
)
def _(spark, d):
    """Each sale against the whole catalogue: the entry that shares most words with its name, then the cheapest."""
    part = table(spark, d, "part")
    asked = table(spark, d, "lineitem").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")
    names = part.select("p_name").distinct()
    best = matching.most_shared(names.withColumn("words", F.split("p_name", " ")), part.withColumn("words", F.split("p_name", " ")), "p_name", "words", F.struct("p_retailprice", "p_partkey"))
    return asked.join(best, "p_name").select("l_orderkey", "l_linenumber", F.col("best.p_partkey").alias("p_partkey"), F.col("shared").cast("long").alias("shared"))


@query(
    "jn_06_nested_choice",
    """WITH g AS (SELECT l_orderkey, list(struct_pack(price := l_extendedprice, line := l_linenumber, flag := l_returnflag)) AS s FROM lineitem GROUP BY 1)
       SELECT l_orderkey, coalesce(list_sort(list_transform(list_filter(s, lambda x: x.flag = 'R'), lambda x: (x.price, x.line)))[1][2], list_sort(list_transform(s, lambda x: (x.price, x.line)))[1][2]) AS line FROM g""",
)
def _(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag")))).alias("s"))
    return sets.select("l_orderkey", F.coalesce(F.try_element_at(F.filter("s", lambda x: x["flag"] == "R"), F.lit(1))["line"], F.col("s")[0]["line"]).alias("line"))


@query("jn_07_history_enriched", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("jn_10_confirmed_liquidity", f"SELECT o_orderkey, n, {r2('best')} AS best FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("best"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", "n", js_round(F.col("best"), 2).alias("best"))


@query("jn_11_config_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    config = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(config, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("jn_12_membership", "SELECT w AS niche, count(*) AS platforms FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("niche")).groupBy("niche").agg(F.count(F.lit(1)).alias("platforms"))


@query("jn_13_purchase_sale", f"SELECT o_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS held, {r2('l_extendedprice * 0.87 - o_totalprice * 0.1')} AS profit FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R'")
def _(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate", "l_extendedprice")
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate", "o_totalprice").join(sold, "o_orderkey")
    held = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long")
    return rows.select("o_orderkey", "l_linenumber", held.alias("held"), js_round(F.col("l_extendedprice") * 0.87 - F.col("o_totalprice") * 0.1, 2).alias("profit"))


_DETECTORS = {"graded": ("psa|bgs", -30), "lot": ("lot|bundle", -40), "gold": ("gold|or", -20), "set": ("full set|all", -35)}


@query(
    "jn_14_learned_rules",
    "WITH h AS (SELECT doc_id, quality, " + ", ".join(f"CAST(regexp_matches(lower(text), '\\b({p})\\b') AS INTEGER) AS {k}" for k, (p, _) in _DETECTORS.items()) + " FROM documents JOIN labels USING (doc_id)), "
    "n AS (SELECT " + ", ".join(f"sum({k}) FILTER (quality = 0) AS n_{k}" for k in _DETECTORS) + " FROM h) "
    "SELECT doc_id, greatest(-50, " + " + ".join(f"CASE WHEN n_{k} >= 1 THEN {k} * {w} ELSE 0 END" for k, (_, w) in _DETECTORS.items()) + ") AS penalty FROM h CROSS JOIN n",
)
def _(spark, d):
    hits = {k: F.lower("text").rlike(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])").cast("int") for k, (p, _) in _DETECTORS.items()}
    rows = table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in hits.items()]).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    counts = rows.agg(*[F.sum(F.when(F.col("quality") == 0, F.col(k))).alias(f"n_{k}") for k in _DETECTORS])
    penalty = sum((F.when(F.col(f"n_{k}") >= 1, F.col(k) * w).otherwise(0) for k, (_, w) in _DETECTORS.items()), F.lit(0))
    return rows.crossJoin(F.broadcast(counts)).select("doc_id", F.greatest(F.lit(-50), penalty).alias("penalty"))  # one row


@query("jn_15_covered_categories", "SELECT DISTINCT p_type FROM part p WHERE EXISTS (SELECT 1 FROM region r WHERE contains(lower(p.p_name), substr(lower(r.r_name), 3, 2)))")
def _(spark, d):
    """Categories with a product that a query's keyword covers: keywords are two letters, so all of them are one row."""
    words = table(spark, d, "region").agg(F.collect_set(F.substring(F.lower("r_name"), 3, 2)).alias("words"))
    rows = table(spark, d, "part").crossJoin(F.broadcast(words))  # one row
    return rows.where(F.exists("words", lambda w: F.lower("p_name").contains(w))).select("p_type").distinct()


@query("jn_16_number_conflict", "SELECT p_partkey, len(list_intersect(regexp_extract_all(p_brand || ' ' || p_partkey, '[0-9]+'), regexp_extract_all(p_size || ' ' || (p_partkey % 30), '[0-9]+'))) > 0 AS conflict FROM part")
def _(spark, d):
    numbers = lambda *c: F.regexp_extract_all(F.concat_ws(" ", *c), F.lit("[0-9]+"), F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(numbers("p_brand", "p_partkey"), numbers("p_size", (F.col("p_partkey") % 30).cast("string"))).alias("conflict"))


@query(
    "ag_30_supervisor_summary",
    f"WITH v AS (SELECT CASE WHEN l_linestatus <> 'O' THEN 'expired' WHEN l_discount - 0.02 <= 0 THEN 'rejected' WHEN l_quantity < 30 THEN 'low_confidence' ELSE 'confirmed' END AS verdict, l_quantity AS q FROM lineitem) SELECT verdict, count(*) AS n, {r2('CAST(sum(q) AS DOUBLE) / count(*)')} AS mean_confidence FROM v GROUP BY 1",
)
def _(spark, d):
    from ..operators import scores

    verdict = scores.supervise(F.col("l_linestatus") == "O", F.col("l_discount") - 0.02, F.col("l_quantity"), F.lit(30))
    return table(spark, d, "lineitem").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), js_round(F.sum("l_quantity") / F.count(F.lit(1)), 2).alias("mean_confidence"))


@query("ag_31_evaluator_health", f"SELECT event_type, count(*) AS runs, count(*) FILTER (value > 450) AS errors, {r2('CAST(count(*) FILTER (value > 450) AS DOUBLE) / count(*)')} AS error_rate FROM events GROUP BY 1")
def _(spark, d):
    out = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("value") > 450).alias("errors"))
    return out.withColumn("error_rate", js_round(F.col("errors") / F.col("runs"), 2))


@query("ag_39_explorer_summary", f"WITH r AS (SELECT p_type, p_partkey, p_retailprice * 0.3 - 200 AS net, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_type, count(*) AS n, {r2('median(net)')} AS median_net, max(p_partkey) FILTER (k = 1) AS best FROM r GROUP BY 1")
def _(spark, d):
    net = F.col("p_retailprice") * 0.3 - 200
    ranked = table(spark, d, "part").withColumn("net", net).withColumn("k", F.row_number().over(Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")))
    return ranked.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), js_round(F.median("net"), 2).alias("median_net"), F.max(F.when(F.col("k") == 1, F.col("p_partkey"))).alias("best"))


@query("dm_27_adjustments", "WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, CASE WHEN n >= 20 AND bad * 1.0 / n >= 0.95 THEN 'disable' WHEN n >= 5 AND bad * 1.0 / n > 0.2 THEN 'tighten' ELSE 'keep' END AS action, least(3, 1 + CASE WHEN bad * 1.0 / n > 0.3 THEN 1 ELSE 0 END) AS min_observations FROM g")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("bad"))
    rate = F.col("bad") / F.col("n")
    action = F.when((F.col("n") >= 20) & (rate >= 0.95), "disable").when((F.col("n") >= 5) & (rate > 0.2), "tighten").otherwise("keep")
    return g.select("source", action.alias("action"), F.least(F.lit(3), 1 + F.when(rate > 0.3, 1).otherwise(0)).alias("min_observations"))


@query("dm_28_health_decisions", "WITH g AS (SELECT event_type, count(*) AS runs, count(*) FILTER (value > 250) * 1.0 / count(*) AS err FROM events GROUP BY 1), u AS (SELECT event_type, 'disable_vision' AS action, 2 AS hours FROM g WHERE err > 0.15 AND runs >= 3 UNION ALL SELECT event_type, 'lower_thresholds', 4 FROM g WHERE err <= 0.15 UNION ALL SELECT event_type, 'purge', 24 FROM g WHERE runs > 2000) SELECT * FROM u")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), (F.count_if(F.col("value") > 250) / F.count(F.lit(1))).alias("err"))
    rules = F.array_compact(F.array(
        F.when((F.col("err") > 0.15) & (F.col("runs") >= 3), F.struct(F.lit("disable_vision").alias("action"), F.lit(2).alias("hours"))),
        F.when(F.col("err") <= 0.15, F.struct(F.lit("lower_thresholds").alias("action"), F.lit(4).alias("hours"))),
        F.when(F.col("runs") > 2000, F.struct(F.lit("purge").alias("action"), F.lit(24).alias("hours"))),
    ))
    return g.select("event_type", F.inline(rules))


@query("dm_34_suggestions", "WITH f AS (SELECT l_orderkey, l_linenumber, l_shipdate, unnest(list_filter([CASE WHEN l_discount < 0.03 THEN 'raise_margin' END, CASE WHEN l_quantity < 10 THEN 'more_observations' END], lambda x: x IS NOT NULL)) AS suggestion FROM lineitem) SELECT l_orderkey, l_linenumber, suggestion FROM f ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, suggestion LIMIT 200")
def _(spark, d):
    failing = F.array_compact(F.array(F.when(F.col("l_discount") < 0.03, "raise_margin"), F.when(F.col("l_quantity") < 10, "more_observations")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.explode(failing).alias("suggestion"))
    return rows.orderBy(F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "suggestion").limit(200).select("l_orderkey", "l_linenumber", "suggestion")


@query("fs_17_domain_terms", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 'ring' WHEN list_contains(string_split(p_name, ' '), 'bolt') THEN 'bolt' END AS term, len(list_filter(string_split(p_name, ' '), lambda x: list_contains(['red', 'blue', 'green', 'black', 'white'], x))) AS colours FROM part")
def _(spark, d):
    tokens = slug_tokens(F.col("p_name"))
    colours = F.array_intersect(tokens, F.array(*[F.lit(x) for x in ("red", "blue", "green", "black", "white")]))
    term = F.when(F.array_contains(tokens, "ring"), "ring").when(F.array_contains(tokens, "bolt"), "bolt")
    return table(spark, d, "part").select("p_partkey", term.alias("term"), F.size(colours).cast("long").alias("colours"))


@query(
    "jn_03_image_peers",
    f"""WITH e AS (SELECT vec_id, label, embedding, CAST((vec_id * 37) % 199 + 2 AS DOUBLE) AS price FROM embeddings),
        k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY price, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM e),
        m AS (SELECT c.vec_id, c.price, list_sort(list(r.price)) AS ps FROM k c JOIN k r ON c.label = r.label AND c.n >= 4 AND c.k <= ceil(c.n / 4) AND r.k > ceil(r.n / 4) AND list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) >= 0.15 GROUP BY ALL)
        SELECT vec_id, len(ps) AS peers, {r2('list_sum(ps) / len(ps)')} AS average, ps[len(ps) // 2 + 1] AS median, floor((1 - price / ps[len(ps) // 2 + 1]) * 100 + 0.5) AS discount FROM m WHERE len(ps) >= 2 AND 1 - price / ps[len(ps) // 2 + 1] >= 0.5""",
)
def _(spark, d):
    """The vectors are noise, so they count as alike from 0.15 on."""
    rows = table(spark, d, "embeddings").withColumn("price", (F.col("vec_id") * 37 % 199 + 2).cast("double"))
    found = peers.cheap_against_rest(rows, "label", "vec_id", "price", "embedding", 0.15)
    off = 1 - F.col("price") / F.col("median")
    return found.where(off >= 0.5).select("vec_id", "peers", js_round(F.col("mean"), 2).alias("average"), "median", js_round(off * 100, 0).alias("discount"))
