"""Pages to rows. Embedded JSON first, tags as the fallback; all by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, normalize_spaces
from ..functions.numbers import or_else  # noqa: F401  shared with the JSON scans

#: What blocked and challenge pages contain.
BLOCKED = ("captcha", "access denied", "datadome", "are you a human", "unusual traffic", "just a moment", "cf-challenge")
#: How a page says that the item is gone.
SOLD = ("sold", "vendu", "verkauft", "vendido", "venduto")


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such tag, entities decoded, inner tags dropped; null if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(normalize_spaces(decode_entities(F.regexp_replace(inner, "<[^>]*>", " "))), F.lit(""))


def embedded_json(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """The JSON document that a page carries for its own scripts; null if there is none."""
    return F.nullif(F.regexp_extract(html, rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def scan_listings(pages: DataFrame, items_path: str, item: str, html: str = "html", url: str = "url") -> DataFrame:
    """(url, strategy, title, price, link): items of the embedded JSON, else the page's own title and links."""
    doc = embedded_json(F.col(html))
    found = pages.select(url, html, F.from_json(F.get_json_object(doc, items_path), f"array<struct<{item}>>").alias("_items"))
    by_json = found.where(F.size("_items") > 0).select(url, F.lit("json").alias("strategy"), F.inline("_items"))
    by_tags = found.where(F.coalesce(F.size("_items"), F.lit(-1)) <= 0)
    links = F.expr(f"""zip_with(regexp_extract_all({html}, '(?i)<a[^>]*href="([^"]*)"', 1), regexp_extract_all({html}, '(?is)<a[^>]*>(.*?)</a>', 1), (u, t) -> named_struct('title', t, 'link', u))""")
    by_tags = by_tags.select(url, F.lit("tags").alias("strategy"), F.inline(links))
    return by_json.unionByName(by_tags, allowMissingColumns=True)


def is_blocked(html: Column) -> Column:
    low = F.lower(html)
    return F.exists(F.array(*[F.lit(m) for m in BLOCKED]), lambda m: low.contains(m))


#: What pages that keep machines out contain, and what pages with data for machines or with marked-up items do.
ANTI_BOT = ("captcha", "cloudflare", "datadome", "recaptcha", "robot", "access denied", "blocked")
DATA, MARKED = ('"price"', '"items"', '"products"'), ("itemscope", "data-testid", 'class="product')


def _any_of(low: Column, marks) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: low.contains(m))


def anti_bot(html: Column) -> Column:
    """Whether a page looks like one that keeps machines out."""
    return _any_of(F.lower(html), ANTI_BOT)


def scrape_method(html: Column) -> Column:
    """``api_json`` for pages with data, ``html_structured`` for marked-up items, else null."""
    low = F.lower(html)
    return F.when(_any_of(low, DATA), "api_json").when(_any_of(low, MARKED), "html_structured")


def is_sold(html: Column) -> Column:
    words = "|".join(SOLD)
    return F.lower(html).rlike(rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])")


def labelled_price(html: Column, label: str) -> Column:
    """The number after a label, with decimal comma or point."""
    raw = F.regexp_extract(html, rf"(?is){label}[^0-9<]*(?:<[^>]*>\s*)*([0-9]+(?:[.,][0-9]{{1,2}})?)", 1)
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def page_status(html: Column, items: Column, least: int = 3000) -> Column:
    """blocked, empty, parsing_broken or ok."""
    return F.when(is_blocked(html), "blocked").when(F.length(html) < least, "empty").when(items == 0, "parsing_broken").otherwise("ok")


def with_fallback(sources: list[DataFrame], key: str, least: int) -> DataFrame:
    """Rows of each source in order, as long as the earlier ones gave a key fewer than ``least`` rows."""
    out = None
    for k, source in enumerate(sources):
        source = source.withColumn("source_no", F.lit(k))
        if out is None:
            out = source
            continue
        counts = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
        out = out.unionByName(source.join(counts, key, "left_anti"))
    return out


#: The keys under which a page's document leads to its listings, in the order they are tried.
AD_KEYS = ("ads", "results", "items", "listings", "props", "pageProps", "data")
AD_DEPTH, AD_HEADS = 8, 5


def find_ads(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, ads): the JSON of the first array in a document whose head has a subject and a price, for the keys that have one.

    Each round opens the nodes of a level, a row each, by ``variant_explode``: arrays
    have their first elements opened, objects the keys that lead to listings, and
    leaves have nothing to open. A node that looks like listings goes on as it is. The way
    to a node is one letter a step, so the least way is the one that a search in depth
    would find first. No round shuffles; ``key`` must tell the rows apart.
    """
    spark = rows.sparkSession
    filled = lambda node, path: F.coalesce(~F.try_variant_get(node, path, "string").isin("", "0", "false"), F.lit(False))
    found = lambda node: filled(node, "$[0].subject") & filled(node, "$[0].price")
    letter = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(AD_KEYS) for x in (name, chr(97 + k))]), F.col("key"))
    step = F.when(F.col("key").isNull(), F.char(F.col("pos") + 97 + len(AD_KEYS))).otherwise(letter)
    nodes = rows.select(F.col(key).alias("_id"), F.lit("").alias("_way"), F.try_parse_json(document).alias("_node")).where("_node IS NOT NULL").withColumn("_found", found(F.col("_node")))
    for _ in range(AD_DEPTH):
        opened = nodes.withColumn("_open", F.when(F.col("_found"), F.to_variant_object(F.array("_node"))).otherwise(F.col("_node")))
        below = opened.lateralJoin(spark.tvf.variant_explode(F.col("_open").outer()))
        below = below.where(F.col("_found") | F.col("key").isin(*AD_KEYS) | (F.col("key").isNull() & (F.col("pos") < AD_HEADS)))
        nodes = below.select("_id", F.when(F.col("_found"), F.col("_way")).otherwise(F.concat("_way", step)).alias("_way"), F.col("value").alias("_node"), (F.col("_found") | found(F.col("value"))).alias("_found"))
    first = nodes.where("_found").select("_id", F.struct("_way", F.to_json("_node").alias("ads")).alias("_first")).groupBy("_id").agg(F.min("_first").alias("_first"))
    return first.select(F.col("_id").alias(key), "_first.ads")
