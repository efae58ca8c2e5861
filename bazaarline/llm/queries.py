"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, decontaminate, divergence, exact_dedup, language, lexical, mixing, quality, sanitise, simhash, spotsigs, token_counts, token_files
from .storage import keep, work_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(bpe_chunks.decode(bpe_chunks.encode(_docs(spark, sf_dir), BYTE_BPE), BYTE_BPE))


def with_digests(coded: DataFrame) -> DataFrame:
    """Of (doc_id, ids, decoded): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.with_copies(_docs(spark, sf_dir), carry=[])
    return drawn.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so each run does the whole work."""
    counts = token_counts.count_tokens(_docs(spark, sf_dir), work_path(spark, "token-counts"), PIECE_BPE)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_docs(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_docs(spark, sf_dir), digest=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_docs(spark, sf_dir), work_path(spark, "token-files"), BYTE_BPE)
    return token_files.read_documents(manifest)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(_docs(spark, sf_dir))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = spotsigs.compare_with_edits(_docs(spark, sf_dir))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = keep(compared.withColumn("edited_sha256", F.sha2("edited", 256)).select(*names, "signatures"), "spot-rows")
    classes = spotsigs.near_classes(rows.select(F.col("doc_id").alias("_id"), "fingerprint", "signatures"))
    return rows.select(*names).join(classes, "fingerprint").select(*names, "near_class")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(_docs(spark, sf_dir)), _items(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_docs(spark, sf_dir))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_docs(spark, sf_dir), _items(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_files": op8_token_files,
    "op9_pii": op9_pii,
    "op10_spotsigs": op10_spotsigs,
    "op11_lexical": op11_lexical,
    "op12_divergence": op12_divergence,
    "op13_decontaminate": op13_decontaminate,
}

ORACLES = {
    "op2_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS h FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), r AS (
          SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
        ), c AS (
          SELECT *, 1 + (k - 1) % 3 AS w, source_size * 3 AS cap, source_size * 3 / CAST(1 + (k - 1) % 3 AS DOUBLE) AS ratio FROM r
        ), v AS (
          SELECT *, CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
                  / CAST((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
          FROM c WINDOW o AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
          SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, (ratio, k)) FROM v WHERE ratio >= level) * w, CAST(cap AS DOUBLE))) AS target,
                 CAST(CAST('0x' || substr(md5('20240:' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
          FROM v
        ), n AS (
          SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 row_number() OVER (PARTITION BY d.source ORDER BY
                   CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) % 8 END,
                   substr(h, 1, 1) || translate(substr(h, 2, 1), '0123456789abcdef', '0000111122223333'), size, h) AS place
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), m AS (
          SELECT *, CAST(least(floor(rate * place + u) - floor(rate * (place - 1) + u), ceil(rate)) AS BIGINT) AS copies FROM n
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, copies FROM m""",
    "op7_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op11_lexical": r"""
        WITH w AS (
          SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
        ), s AS (
          SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_words FROM w WHERE len(ts) > 0
        ), q AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
        ), p AS (
          SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL
        ), k AS (
          SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n_docs
        ), f AS (
          SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n_docs) // n_words)))) AS BIGINT) AS score
          FROM q JOIN p USING (t) JOIN k USING (t) JOIN w USING (r), s GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM f JOIN w USING (r) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op12_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
        ), o AS (
          SELECT r, lang, source, t, count(*) AS c FROM (SELECT r, lang, source, unnest(ts) AS t FROM d) GROUP BY ALL
        ), v AS (
          SELECT lang, t FROM o GROUP BY ALL HAVING count(*) >= 3
        ), n AS (
          SELECT lang, source, t, CAST(sum(c) AS BIGINT) AS c FROM o SEMI JOIN v ON o.lang = v.lang AND o.t = v.t GROUP BY ALL
        ), g AS (
          SELECT lang, source, coalesce(total, 0) AS total, coalesce(V, 0) AS V FROM (SELECT DISTINCT lang, source FROM d)
          LEFT JOIN (SELECT lang, source, CAST(sum(c) AS BIGINT) AS total FROM n GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS V FROM v GROUP BY ALL) USING (lang)
        ), p AS (
          SELECT g.lang, g.source, v.t, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // (total + V) AS p
          FROM g JOIN v ON g.lang = v.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = v.t
        ), x AS (
          SELECT a.lang, a.source, b.source AS item, coalesce(sum(((y.p - z.p) * (y.p - z.p)) // z.p), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p y ON y.lang = a.lang AND y.source = a.source LEFT JOIN p z ON z.lang = b.lang AND z.source = b.source AND z.t = y.t GROUP BY ALL
        ), q AS (
          SELECT lang, t, 1 + (CAST(1000000000 AS HUGEINT) * (c + 1)) // (total + V) AS q FROM (SELECT lang, t, sum(c) AS c FROM n GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total, any_value(V) AS V FROM g GROUP BY ALL) USING (lang)
        ), y AS (
          SELECT lang, source, t AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM (SELECT *, 'pair' AS part FROM x UNION ALL SELECT *, 'term' AS part FROM y)
        QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200""",
}
