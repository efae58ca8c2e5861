"""Text, date, similarity and array functions FS, FD, FM, FA and FJ."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, numbers, text
from ..functions.lexicon import FRENCH_TO_ENGLISH
from ..operators.signature import translated
from .base import AS_OF, clock, query, r2, table, when_ts

_SLUG = "list_filter(string_split_regex(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s/#-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"


def _documents(spark, d):
    return table(spark, d, "documents")


@query("fs_01_normalize_spaces", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return _documents(spark, d).select("doc_id", F.md5(text.normalize_spaces(F.col("text")).cast("binary")).alias("h"))


@query("fs_02_slug_tokens", f"WITH t AS (SELECT doc_id, {_SLUG.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS h FROM t")
def _(spark, d):
    return _documents(spark, d).withColumn("t", text.slug_tokens(F.col("text"))).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("h"))


def _in_english(text: str) -> str:
    """SQL of the replacements, one within the other."""
    for french in sorted(FRENCH_TO_ENGLISH, key=len, reverse=True):
        text = f"regexp_replace({text}, '\\b{french}\\b', '{FRENCH_TO_ENGLISH[french]}', 'g')"
    return text


@query("fs_03_translation", f"SELECT doc_id, {_in_english('lower(strip_accents(text))')} AS english FROM documents WHERE lang = 'fr'")
def _(spark, d):
    """French titles in English: sixty replacements, longest phrases first."""
    return _documents(spark, d).where("lang = 'fr'").select("doc_id", translated(text.strip_accents(F.col("text"))).alias("english"))


@query(
    "fs_04_comparable_token",
    "WITH p AS (SELECT p_partkey, '#' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '/' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS t FROM part) SELECT p_partkey, CAST(CAST(regexp_extract(t, '#([0-9]+)/', 1) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(regexp_extract(t, '/([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS token FROM p",
)
def _(spark, d):
    raw = F.concat(F.lit("#"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    return table(spark, d, "part").select("p_partkey", text.comparable_token(raw).alias("token"))


@query(
    "fs_10_product_key",
    "WITH k AS (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s/\\-#]', ' ', 'g')), '\\s+', '-', 'g'), 1, 150) AS k FROM documents) SELECT doc_id, CASE WHEN k = '' THEN 'unknown' ELSE k END AS product_key FROM k",
)
def _(spark, d):
    return _documents(spark, d).select("doc_id", text.product_key(F.col("text")).alias("product_key"))


@query(
    "fs_11_title_keys",
    """SELECT doc_id, substr(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), 1, 80) AS title, substr(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g'), 1, 80) AS dense FROM documents""",
)
def _(spark, d):
    return _documents(spark, d).select("doc_id", text.title_key(F.col("text"), 80).alias("title"), text.title_key(F.col("text"), 80, keep_spaces=False).alias("dense"))


@query(
    "fs_12_euro_amount",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EUR ' || CAST(p_size AS VARCHAR) || ',5' WHEN 1 THEN '1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',56 €' WHEN 2 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE 'n/a' END AS t FROM part)
       SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(regexp_extract(t, '([0-9]+),', 1) || '.5' AS DOUBLE) WHEN 1 THEN CAST('1' || substr(t, 3, 3) || '.56' AS DOUBLE) WHEN 2 THEN CAST('1' || substr(t, 3, 3) AS DOUBLE) END AS amount FROM p""",
)
def _(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("EUR "), size, F.lit(",5"))).when(k == 1, F.concat(F.lit("1."), F.lpad(size, 3, "0"), F.lit(",56 €"))).when(k == 2, F.concat(F.lit("1,"), F.lpad(size, 3, "0"))).otherwise("n/a")
    return table(spark, d, "part").select("p_partkey", text.euro_amount(raw).alias("amount"))


@query("fs_14_decode_entities", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&euro;', '€'), '&lt;', '<'), '&gt;', '>')) AS h FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.decode_entities(F.col("html")).cast("binary")).alias("h"))


_LANGUAGES = [("fr", ["le", "les", "des", "du", "une", "et"]), ("de", ["der", "die", "das", "und", "ist"]), ("es", ["el", "los", "las", "que", "del"]), ("en", ["the", "of", "and", "is"])]


@query(
    "fs_15_language_words",
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(text), '\\b({'|'.join(w)})\\b') THEN '{k}'" for k, w in _LANGUAGES)
    + " ELSE 'unknown' END AS language, "
    + " + ".join(f"CAST(regexp_matches(lower(text), '\\b({'|'.join(w)})\\b') AS INTEGER)" for _, w in _LANGUAGES)
    + " > 1 AS mixed FROM documents",
)
def _(spark, d):
    hits = {k: F.lower("text").rlike(text.word("|".join(w))) for k, w in _LANGUAGES}
    first = F.coalesce(*[F.when(test, k) for k, test in hits.items()], F.lit("unknown"))
    return _documents(spark, d).select("doc_id", first.alias("language"), (sum(test.cast("int") for test in hits.values()) > 1).alias("mixed"))


@query(
    "fs_16_query_variants",
    f"WITH t AS (SELECT p_partkey, {_SLUG.format("p_name || ' ' || p_size || ' ' || p_brand")} AS t FROM part) SELECT p_partkey, array_to_string(list_slice(list_filter(t, lambda x: regexp_matches(x, '^[a-z]+$')), 1, 4), ' ') AS words, array_to_string(list_distinct(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$'))), ' ') AS numbers FROM t",
)
def _(spark, d):
    rows = table(spark, d, "part").withColumn("t", text.slug_tokens(F.concat_ws(" ", "p_name", "p_size", "p_brand")))
    return rows.select("p_partkey", F.array_join(F.slice(F.filter("t", lambda x: x.rlike("^[a-z]+$")), 1, 4), " ").alias("words"), F.array_join(F.array_distinct(F.filter("t", lambda x: x.rlike("^[0-9]+$"))), " ").alias("numbers"))


@query("fs_18_url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS item, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def _(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract(url, "/([0-9]+)", 1), F.lit("")).alias("item"), F.regexp_extract(url, "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("fs_20_thumbnail_url", "SELECT page_id, regexp_replace(url || '/s-l140.jpg', 's-l[0-9]+\\.', 's-l1600.') AS big FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.concat("url", F.lit("/s-l140.jpg")), r"s-l[0-9]+\.", "s-l1600.").alias("big"))


@query("fs_21_safe_id", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), 1, 100) AS id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_id(F.col("url")).alias("id"))


@query(
    "fd_01_localised_date",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
       SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE day END AS sold_on FROM o""",
)
def _(spark, d):
    """Captions are written from the order's date in French or English, and read back."""
    french = F.array(*[F.lit(x) for x in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")])
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    written = F.when(k == 0, F.concat_ws(" ", F.lit("Vendu le"), F.dayofmonth(day), F.element_at(french, F.month(day)), F.year(day))).when(k == 1, F.concat(F.lit("Sold "), F.date_format(day, "MMM d, yyyy"))).otherwise("Sold today")
    return table(spark, d, "orders").select("o_orderkey", dates.localised_date(written).alias("sold_on"))


@query("fd_02_sold_date", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CASE WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END) AS sold_at FROM events")
def _(spark, d):
    k, ts = F.col("event_id") % 3, when_ts("ts")
    epoch, text_date = F.when(k == 0, F.unix_micros(ts)), F.when(k == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.when(k == 2, F.lit("soon")))
    sold = F.coalesce(F.timestamp_micros(epoch), F.try_to_timestamp(text_date, F.lit("yyyy-MM-dd")))
    return table(spark, d, "events").select("event_id", sold.cast("timestamp_ntz").alias("sold_at"))


@query("fd_03_day_and_age", f"SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / 86400) AS BIGINT) AS age FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), dates.whole_days(when_ts("o_orderdate"), clock(AS_OF)).alias("age"))


@query("fd_04_months_ago", f"SELECT o_orderkey, (2001 - year(o_orderdate)) * 12 + 12 - month(o_orderdate) AS months FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.months_ago(when_ts("o_orderdate"), clock(AS_OF)).cast("long").alias("months"))


@query(
    "fd_05_next_weekly",
    """WITH a AS (SELECT event_id, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_days(CAST((1 - dayofweek(ts) + 7) % 7 AS INTEGER)) + INTERVAL 9 HOUR AS due FROM events) SELECT event_id, CASE WHEN due > ts THEN due ELSE due + INTERVAL 7 DAY END AS next_run FROM a""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", dates.next_weekly(when_ts("ts"), 1, 9).cast("timestamp_ntz").alias("next_run"))


@query(
    "fd_06_duration",
    """WITH e AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took FROM e""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", dates.duration(F.floor(F.col("value") * 60)).alias("took"))


@query("fd_07_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (11, 12) THEN 'holiday' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' ELSE 'regular' END AS season FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.season(F.col("o_orderdate")).alias("season"))


@query(
    "fm_01_euros",
    f"""WITH o AS (SELECT o_orderkey, o_totalprice AS p, o_custkey % 5 AS k FROM orders) SELECT o_orderkey, {r2("p * CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.865 WHEN 2 THEN 1.153 END")} AS euros, {r2("p * CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.865 WHEN 2 THEN 1.153 WHEN 3 THEN 0.67 ELSE 0.865 END")} AS euros_api FROM o""",
)
def _(spark, d):
    k = F.col("o_custkey") % 5
    currency = F.when(k == 0, "eur").when(k == 1, "USD").when(k == 2, "GBP").when(k == 3, "CAD").otherwise("JPY")
    amount = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", numbers.euros(amount, currency).alias("euros"), numbers.euros(amount, currency, numbers.EURO_RATES_API, "USD").alias("euros_api"))


_LEVELS = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100 + 128) AS BIGINT))"


@query(
    "fm_04_likeness",
    f"""WITH v AS (SELECT vec_id, {_LEVELS} AS a FROM embeddings), p AS (SELECT l.vec_id, l.a AS a, r.a AS b FROM v l JOIN v r ON r.vec_id = l.vec_id + 1)
        SELECT vec_id, 1 - CAST(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS DOUBLE) / (64 * 255) AS levels FROM p""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 128)).alias("a"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", arrays.level_likeness(F.col("a"), F.col("b")).alias("levels"))


@query(
    "fm_05_hashes",
    f"""WITH v AS (SELECT vec_id, {_LEVELS} AS a FROM embeddings)
        SELECT vec_id, array_to_string(list_transform(a, lambda x: CASE WHEN x >= CAST(list_sum(a) AS DOUBLE) / 64 THEN '1' ELSE '0' END), '') AS mean_hash,
        array_to_string(list_transform(list_filter(range(1, 64), lambda k: k % 8 <> 0), lambda k: CASE WHEN a[k] > a[k + 1] THEN '1' ELSE '0' END), '') AS step_hash FROM v""",
)
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 128)).alias("a"))
    return v.select("vec_id", arrays.mean_hash(F.col("a")).alias("mean_hash"), arrays.step_hash(F.col("a"), 8).alias("step_hash"))


@query("fm_07_word_jaccard", "WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2)) AS a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: length(x) >= 2)) AS b FROM part) SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) AS j FROM t")
def _(spark, d):
    long_words = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: F.length(x) >= 2)
    return table(spark, d, "part").select("p_partkey", text.jaccard(long_words("p_name"), long_words("p_type")).alias("j"))


@query("fm_09_set_price", "SELECT p_partkey, greatest(10.0, floor(p_size * 10 * CAST(CASE WHEN p_retailprice > 1500 THEN 0.15 WHEN p_retailprice > 1000 THEN 0.12 ELSE 0.1 END AS DOUBLE) * CASE WHEN p_size > 30 THEN 1.5 ELSE 1.0 END / 5 + 0.5) * 5) AS price FROM part")
def _(spark, d):
    rate = F.when(F.col("p_retailprice") > 1500, 0.15).when(F.col("p_retailprice") > 1000, 0.12).otherwise(0.1)
    raw = F.col("p_size") * 10 * rate * F.when(F.col("p_size") > 30, 1.5).otherwise(1.0)
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(10.0), numbers.js_round(raw / 5) * 5).alias("price"))


@query("fa_01_distinct_in_order", "SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n, string_split(text, ' ')[1] AS first FROM documents")
def _(spark, d):
    words = F.array_distinct(F.split("text", " "))
    return _documents(spark, d).select("doc_id", F.size(words).cast("long").alias("n"), words[0].alias("first"))


@query("fa_02_first_where", f"WITH t AS (SELECT p_partkey, {_SLUG.format("p_name || ' ' || p_size")} AS t FROM part) SELECT p_partkey, list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$'))[1] AS number FROM t")
def _(spark, d):
    rows = table(spark, d, "part").withColumn("t", text.slug_tokens(F.concat_ws(" ", "p_name", "p_size")))
    return rows.select("p_partkey", F.try_element_at(F.filter("t", lambda x: x.rlike("^[0-9]+$")), F.lit(1)).alias("number"))


@query("fa_03_group_key", f"WITH t AS (SELECT p_partkey, {_SLUG.format('p_name')} AS t FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), '+') AS k FROM t")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", arrays.group_key(text.slug_tokens(F.col("p_name"))).alias("k"))


@query("fa_04_prefix_exists", f"WITH t AS (SELECT p_partkey, {_SLUG.format('p_name')} AS a, {_SLUG.format('p_type')} AS b FROM part) SELECT p_partkey, len(list_filter(a, lambda x: length(x) >= 4 AND len(list_filter(b, lambda y: starts_with(y, x))) > 0)) > 0 AS hit FROM t")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", arrays.prefix_exists(text.slug_tokens(F.col("p_name")), text.slug_tokens(F.col("p_type"))).alias("hit"))


@query("fa_05_latest_with", "SELECT l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) FILTER (l_discount > 0.05) AS latest FROM lineitem GROUP BY 1")
def _(spark, d):
    row = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", F.when(F.col("l_discount") > 0.05, row)).alias("latest"))


@query("fa_06_count_map", "SELECT user_id, map_from_entries(list((event_type, n) ORDER BY event_type)) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("counts"))


@query("fa_07_first_price", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN p_retailprice * 0.9 ELSE p_retailprice * 0.8 END AS price FROM part")
def _(spark, d):
    k, p = F.col("p_size") % 3, F.col("p_retailprice")
    prices = F.map_from_entries(F.array_compact(F.array(F.when(k == 0, F.struct(F.lit("market").alias("k"), p.alias("v"))), F.when(k <= 1, F.struct(F.lit("mid").alias("k"), (p * 0.9).alias("v"))), F.struct(F.lit("low").alias("k"), (p * 0.8).alias("v")))))
    return table(spark, d, "part").select("p_partkey", arrays.first_price(prices).alias("price"))


@query("fj_02_answer_repair", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    answer = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.from_json(arrays.first_object(answer), "k long")["k"].alias("k"))


@query("fj_03_price_shapes", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN floor(value * 100 + 0.5) / 100 END AS price FROM events")
def _(spark, d):
    k, v = F.col("event_id") % 3, numbers.js_round(F.col("value"), 2).cast("string")
    shape = F.when(k == 0, F.concat(F.lit('{"price":{"amount":"'), v, F.lit('"}}'))).when(k == 1, F.concat(F.lit('{"price":'), v, F.lit("}"))).otherwise('{"title":"none"}')
    return table(spark, d, "events").select("event_id", arrays.price_of(shape).alias("price"))
