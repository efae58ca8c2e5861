"""Set, merge and upsert operators ST-01 to ST-14, and the joins that drop or add rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import cents, js_round
from ..functions.text import jaccard, slug_tokens, title_key
from ..operators import dedup, merge
from ..sources.store import Store
from .base import AS_OF, EVENTS_AS_OF, c, clock, query, scratch, table, when_ts


def _halves(spark, d):
    """Orders as a current and a previous snapshot of customers' states."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("url"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), when_ts("o_orderdate").alias("seen"))
    last = lambda df: dedup.first_per(df, ["url"], [F.col("o_orderkey").desc()])
    return last(orders.where("o_orderkey % 3 = 0")), last(orders.where("o_orderkey % 3 <> 0"))


_HALVES = """WITH o AS (SELECT o_custkey AS url, o_orderkey, o_orderstatus, o_totalprice AS price, o_orderdate AS seen FROM orders),
       new AS (SELECT * FROM o WHERE o_orderkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY o_orderkey DESC) = 1),
       old AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY o_orderkey DESC) = 1)"""


def _store(spark, key: str, schema: str) -> Store:
    return Store(scratch(spark, "store"), key, schema, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("st_01_union_of_platforms", "SELECT 'doc' AS platform, doc_id AS id, n_chars AS size, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("platform"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("platform"), F.col("page_id").alias("id"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@query(
    "st_02_merge_with_history",
    f"""{_HALVES} SELECT new.url, new.o_orderkey, least(new.seen, coalesce(old.seen, new.seen)) AS first_seen, new.seen AS last_seen, FALSE AS stale FROM new LEFT JOIN old USING (url)
        UNION ALL SELECT url, o_orderkey, seen, seen, TRUE FROM old WHERE o_orderstatus <> 'F' AND seen >= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY AND url NOT IN (SELECT url FROM new)""",
)
def _(spark, d):
    new, old = (x.select("url", "o_orderkey", "o_orderstatus", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")) for x in _halves(spark, d))
    keep = (F.col("o_orderstatus") != "F") & (F.col("last_seen") >= clock(AS_OF) - F.expr("INTERVAL 900 DAYS"))
    merged = merge.merge_history(new, old, "url", "first_seen", "last_seen", keep)
    return merged.select("url", "o_orderkey", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "stale")


@query("st_03_snapshot_overlay", f"{_HALVES} SELECT url, o_orderkey FROM new UNION ALL SELECT url, o_orderkey FROM old WHERE url NOT IN (SELECT url FROM new)")
def _(spark, d):
    """The old snapshot is kept by url in buckets; the new one rewrites those that it touches."""
    new, old = (x.select("url", "o_orderkey", "seen") for x in _halves(spark, d))
    kept = _store(spark, "url", "url long, o_orderkey long, seen timestamp").create(old)
    kept.upsert(new, "o_orderkey")
    return kept.read(spark).select("url", "o_orderkey")


@query(
    "st_04_history_upsert",
    f"""{_HALVES} SELECT url, CASE WHEN old.o_orderstatus = 'F' AND new.url IS NULL THEN 'expired' WHEN url % 10 = 0 AND old.url IS NOT NULL THEN 'manual' WHEN new.price > 100000 THEN 'active' WHEN new.url IS NOT NULL THEN 'candidate' ELSE 'kept' END AS status,
        CASE WHEN url % 10 = 0 AND old.url IS NOT NULL THEN old.price ELSE coalesce(new.price, old.price) END AS price FROM old FULL JOIN new USING (url)""",
)
def _(spark, d):
    new, old = _halves(spark, d)
    was, now = F.col("t_o_orderkey").isNotNull(), F.col("s_o_orderkey").isNotNull()
    manual = (F.col("url") % 10 == 0) & was
    status = F.when((F.col("t_o_orderstatus") == "F") & ~now, "expired").when(manual, "manual").when(F.col("s_price") > 100_000, "active").when(now, "candidate").otherwise("kept")
    price = F.when(manual, F.col("t_price")).otherwise(F.coalesce("s_price", "t_price"))
    return merge.upsert(old, new, "url", {"status": status, "price": price})


@query(
    "st_05_key_migration",
    f"""SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS new_key, count(*) AS products, CAST(sum({c('p_retailprice')}) AS BIGINT) AS price_cents, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1""",
)
def _(spark, d):
    key = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-")
    return table(spark, d, "part").groupBy(key.alias("new_key")).agg(F.count(F.lit(1)).alias("products"), F.sum(cents(F.col("p_retailprice"))).alias("price_cents"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))


@query(
    "st_06_expiry",
    f"""WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'candidate' ELSE 'other' END AS status, floor(epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / 86400) AS age, o_custkey % 50 = 0 AS manual FROM orders)
        SELECT o_orderkey, CASE WHEN manual THEN status WHEN status = 'active' AND age > 7 THEN 'expired' WHEN status = 'candidate' AND age > 3 THEN 'expired' ELSE status END AS status FROM o""",
)
def _(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "O", "active").when(s == "P", "candidate").otherwise("other")
    age = F.floor((F.unix_micros(clock(AS_OF)) - F.unix_micros(when_ts("o_orderdate"))) / 86_400_000_000)
    return table(spark, d, "orders").select("o_orderkey", merge.expired(status, F.lit(None), age, F.col("o_custkey") % 50 == 0).alias("status"))


@query("st_07_unseen_history", f"{_HALVES} SELECT url FROM old WHERE url NOT IN (SELECT url FROM new) ORDER BY seen DESC, url LIMIT 15")
def _(spark, d):
    new, old = _halves(spark, d)
    return old.join(new.select("url"), "url", "left_anti").orderBy(F.col("seen").desc(), "url").limit(15).select("url")


@query(
    "st_08_token_sets",
    """WITH t AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9\\s/#-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS b FROM part)
       SELECT p_partkey, len(list_intersect(list_distinct(a), list_distinct(b))) AS shared, len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS extra,
       CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS jaccard FROM t""",
)
def _(spark, d):
    a, b = slug_tokens(F.col("p_name")), slug_tokens(F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_except(b, a)).cast("long").alias("extra"), jaccard(a, b).alias("jaccard"))


@query("st_09_patch_by_key", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'archived' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def _(spark, d):
    """Orders are kept by key in buckets: some are deleted, then the status of others is patched."""
    orders, gone = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = _store(spark, "o_orderkey", "o_orderkey long, status string").create(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")))
    kept.delete(gone)
    kept.patch(orders.where("o_custkey % 7 = 0"), {"status": F.lit("archived")})
    return kept.read(spark)


@query("st_10_protected_prune", "SELECT p_partkey FROM part WHERE p_size > 40 OR (SELECT count(*) FROM part WHERE p_size > 40) < 50")
def _(spark, d):
    return merge.prune_protected(table(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") > 40, 50).select("p_partkey")


@query("st_11_blacklist_upsert", "SELECT o_custkey AS listing_id, count(*) AS dismissed_count, max(o_orderdate) AS dismissed_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("listing_id")).agg(F.count(F.lit(1)).alias("dismissed_count"), F.max("o_orderdate").alias("dismissed_at"))


@query(
    "st_12_price_observations",
    f"""WITH o AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1),
        k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) <= 30)
        SELECT l_partkey, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(sum({c('l_extendedprice')}) AS BIGINT) AS sum_cents FROM k GROUP BY 1""",
)
def _(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    once = dedup.first_per(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], order)
    kept = dedup.top_per(once, "l_partkey", [F.col(x).desc() for x in order], 30)
    return kept.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum(cents(F.col("l_extendedprice"))).alias("sum_cents"))


@query(
    "st_13_mark_sold",
    f"""SELECT o_orderkey AS id, CASE WHEN s.sold IS NOT NULL THEN 'sold' ELSE 'held' END AS status, floor((s.sold - o_totalprice) * 100 + 0.5) / 100 AS profit
        FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS sold FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) s ON o_orderkey = l_orderkey""",
)
def _(spark, d):
    sold = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("sold"))
    held = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(sold, "o_orderkey", "left")
    return held.select(F.col("o_orderkey").alias("id"), F.when(F.col("sold").isNotNull(), "sold").otherwise("held").alias("status"), js_round(F.col("sold") - F.col("o_totalprice"), 2).alias("profit"))


@query(
    "st_14_callback_dispatch",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy_' WHEN 'error' THEN 'ignore_' WHEN 'click' THEN 'verify_' ELSE 'noop_' END || event_id AS data FROM events)
       SELECT event_id, CASE regexp_extract(data, '^(buy|ignore|verify)_(.*)', 1) WHEN 'buy' THEN 'accepted' WHEN 'ignore' THEN 'rejected' WHEN 'verify' THEN 'pending' END AS status FROM e WHERE regexp_matches(data, '^(buy|ignore|verify)_')""",
)
def _(spark, d):
    t = F.col("event_type")
    data = F.concat(F.when(t == "purchase", "buy_").when(t == "error", "ignore_").when(t == "click", "verify_").otherwise("noop_"), F.col("event_id").cast("string"))
    verb = F.regexp_extract("data", "^(buy|ignore|verify)_(.*)", 1)
    status = F.when(verb == "buy", "accepted").when(verb == "ignore", "rejected").when(verb == "verify", "pending")
    return table(spark, d, "events").select("event_id", data.alias("data")).where(verb != "").select("event_id", status.alias("status"))


@query(
    "jn_04_feedback_history",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS decision, source AS category, TRUE AS in_feedback FROM labels LEFT JOIN documents USING (doc_id)
       UNION ALL SELECT doc_id, NULL, source, FALSE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", F.col("source").alias("category")), table(spark, d, "labels")
    decided = labels.join(docs, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), "category", F.lit(True).alias("in_feedback"))
    return decided.unionByName(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("decision"), "category", F.lit(False).alias("in_feedback")))


@query(
    "jn_08_blacklist_anti",
    f"""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY)
        AND substr(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), 1, 80) NOT IN (SELECT substr(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), 1, 80) FROM customer WHERE c_acctbal < -500)""",
)
def _(spark, d):
    people = table(spark, d, "customer").select("c_custkey", title_key(F.col("c_name"), 80).alias("title"), "c_acctbal")
    ids = table(spark, d, "orders").where(when_ts("o_orderdate") >= clock(AS_OF) - F.expr("INTERVAL 400 DAYS")).select(F.col("o_custkey").alias("c_custkey")).distinct()
    return merge.without_listed(people, ids, "c_custkey", people.where("c_acctbal < -500"), "title").select("c_custkey")


@query(
    "jn_09_seen_cache_anti",
    f"""WITH l AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE event_type <> 'error' AND ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 36 HOUR)""",
)
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", when_ts("ts").alias("ts"))
    last = dedup.first_per(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    fresh = last.where((F.col("event_type") != "error") & (F.col("ts") >= F.lit(EVENTS_AS_OF).cast("timestamp") - F.expr("INTERVAL 36 HOURS")))
    return events.select("user_id").distinct().join(fresh.select("user_id"), "user_id", "left_anti")
