"""Projections, filters and predicates PF-01 to PF-19."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import cents
from ..operators import scores
from .base import EVENTS_AS_OF, c, query, table, when_ts


@query("pf_01_min_price", "SELECT p_partkey FROM part WHERE p_retailprice >= 950")
def _(spark, d):
    return table(spark, d, "part").where("p_retailprice >= 950").select("p_partkey")


_PROFILE = {"all": ["red"], "any": ["ring", "bolt", "widget"], "none": ["old"]}


@query("pf_02_search_profile", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'red') AND (contains(lower(p_name || ' ' || p_type), 'ring') OR contains(lower(p_name || ' ' || p_type), 'bolt') OR contains(lower(p_name || ' ' || p_type), 'widget')) AND NOT contains(lower(p_name || ' ' || p_type), 'old')")
def _(spark, d):
    profile = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    tokens = {k: F.array(*[F.lit(t) for t in v]) for k, v in _PROFILE.items()}
    test = F.forall(tokens["all"], lambda t: profile.contains(t)) & F.exists(tokens["any"], lambda t: profile.contains(t)) & ~F.exists(tokens["none"], lambda t: profile.contains(t))
    return table(spark, d, "part").where(test).select("p_partkey")


_STOP = "livre|livres|roman|book|books|with|avec"


@query("pf_03_stop_category", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(strip_accents(lower(text)), '\\b({_STOP})\\b')")
def _(spark, d):
    return table(spark, d, "documents").where(~text.strip_accents(F.lower("text")).rlike(text.word(_STOP))).select("doc_id")


@query("pf_04_single_item", "SELECT doc_id, NOT regexp_matches(lower(text), '\\b(lot|bundle|set of|x ?[2-9])\\b') AS single, NOT (contains(lower(text), 'lot') OR contains(lower(text), 'bundle')) AS plain FROM documents")
def _(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", (~low.rlike(text.word("lot|bundle|set of|x ?[2-9]"))).alias("single"), (~(low.contains("lot") | low.contains("bundle"))).alias("plain"))


@query("pf_05_price_map", "SELECT p_partkey FROM part WHERE p_retailprice <= coalesce(CASE p_type WHEN 'ECONOMY' THEN 1200 WHEN 'SMALL' THEN 1500 END, 1000)")
def _(spark, d):
    most = F.create_map(F.lit("ECONOMY"), F.lit(1200.0), F.lit("SMALL"), F.lit(1500.0))
    return table(spark, d, "part").where(F.col("p_retailprice") <= F.coalesce(F.try_element_at(most, F.col("p_type")), F.lit(1000.0))).select("p_partkey")


@query("pf_06_opportunity", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice * l_discount >= CASE WHEN p_type = 'ECONOMY' THEN 3000 ELSE 2000 END AND l_discount >= CASE WHEN p_type = 'SMALL' THEN 0.08 ELSE 0.05 END")
def _(spark, d):
    own = spark.createDataFrame([("ECONOMY", 3000.0, None), ("SMALL", None, 0.08)], "p_type string, least double, percent double")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(own), "p_type", "left")  # two rows
    test = scores.opportunity(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_discount"), F.coalesce("least", F.lit(2000.0)), F.coalesce("percent", F.lit(0.05)))
    return rows.where(test).select("l_orderkey", "l_linenumber")


@query("pf_07_gates", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 100 < 5 OR l_discount * 500 < 20 THEN 'reject' WHEN l_quantity * 2 >= 50 AND l_tax * 1000 >= 40 THEN 'opportunity' ELSE 'candidate' END AS gate FROM lineitem")
def _(spark, d):
    gate = scores.gate(F.col("l_discount") * 100, F.col("l_discount") * 500, F.col("l_quantity") * 2, F.col("l_tax") * 1000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gate.alias("gate"))


@query("pf_09_status_views", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'active' WHEN o_orderstatus = 'P' OR o_orderstatus = 'O' THEN 'candidate' ELSE 'other' END AS view FROM orders")
def _(spark, d):
    s, seen = F.col("o_orderstatus"), F.col("o_custkey") % 2 == 0
    return table(spark, d, "orders").select("o_orderkey", F.when((s == "O") & seen, "active").when(s.isin("P", "O"), "candidate").otherwise("other").alias("view"))


_RULES = [("price", ["cher", "price", "teuer"]), ("variant", ["the", "der"]), ("condition", ["et", "y"])]


@query("pf_10_reason_class", "SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in _RULES) + " ELSE 'other' END AS reason FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_match(F.lower("text"), _RULES, "other").alias("reason"))


_KINDS = [("jewel", ["ring"]), ("hardware", ["bolt", "nut", "screw"]), ("toy", ["widget", "gadget"])]


@query("pf_11_category", "SELECT p_partkey, CASE " + " ".join("WHEN " + " OR ".join(f"contains(p_name, '{w}')" for w in words) + f" THEN '{name}'" for name, words in _KINDS) + " ELSE 'other' END AS category FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.first_match(F.col("p_name"), _KINDS, "other").alias("category"))


@query("pf_14_aberrant_ratio", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice / coalesce(nullif(p_retailprice, 0), 1) <= 15")
def _(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.where(F.col("l_extendedprice") / F.coalesce(F.nullif("p_retailprice", F.lit(0.0)), F.lit(1.0)) <= 15).select("l_orderkey", "l_linenumber")


@query("pf_15_active_decisions", f"SELECT event_id FROM events WHERE event_type <> 'error' AND (value > 400 OR ts + INTERVAL 24 HOUR > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY)")
def _(spark, d):
    expires = F.when(F.col("value") <= 400, when_ts("ts") + F.expr("INTERVAL 24 HOURS"))
    now = F.lit(EVENTS_AS_OF).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return table(spark, d, "events").where((F.col("event_type") != "error") & (expires.isNull() | (expires > now))).select("event_id")


@query(
    "pf_16_budget_admission",
    "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events WHERE value >= 50) SELECT event_id FROM r WHERE k * 3 <= 200",
)
def _(spark, d):
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").where("value >= 50").withColumn("spent", F.sum(F.lit(3)).over(w)).where("spent <= 200").select("event_id")


@query("pf_17_unified_row", f"SELECT o_orderkey AS id, coalesce(nullif(c_name, ''), 'unknown') AS title, {c('coalesce(nullif(o_totalprice, 0), c_acctbal)')} AS price_cents, n_name AS country FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    price = F.coalesce(F.nullif("o_totalprice", F.lit(0.0)), F.col("c_acctbal"))
    return rows.select(F.col("o_orderkey").alias("id"), F.coalesce(F.nullif("c_name", F.lit("")), F.lit("unknown")).alias("title"), cents(price).alias("price_cents"), F.col("n_name").alias("country"))


@query("pf_18_title_cleanup", "SELECT p_partkey, trim(regexp_replace(regexp_replace('New: ' || p_name || ' - sold out', '^(?i)(new|neuf|neu)[:! ]+', ''), '(?i) - (sold out|vendu|verkauft)$', '')) || CASE WHEN contains(lower(p_name), lower(p_brand)) THEN '' ELSE ' ' || p_brand END AS title FROM part")
def _(spark, d):
    raw = F.concat(F.lit("New: "), "p_name", F.lit(" - sold out"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "(?i)^(new|neuf|neu)[:! ]+", ""), "(?i) - (sold out|vendu|verkauft)$", ""))
    brand = F.when(F.lower("p_name").contains(F.lower("p_brand")), F.lit("")).otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.concat(bare, brand).alias("title"))


_MORE = ["gold", "silver", "red", "blue", "small"]


@query(
    "pf_19_title_enrichment",
    "SELECT p_partkey, array_to_string(list_concat([p_type], list_slice(list_filter(['gold', 'silver', 'red', 'blue', 'small'], lambda w: contains(lower(p_name), w) AND NOT contains(lower(p_type), w)), 1, 2)), ' ') AS title FROM part",
)
def _(spark, d):
    new = F.filter(F.array(*[F.lit(w) for w in _MORE]), lambda w: F.lower("p_name").contains(w) & ~F.lower("p_type").contains(w))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.concat(F.array("p_type"), F.slice(new, 1, 2)), " ").alias("title"))
