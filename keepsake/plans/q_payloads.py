"""Raw payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import order
from keepsake.operators.normalize import capture_to_posts, normalize_payloads, normalize_results
from keepsake.plans import documents as D
from keepsake.plans.registry import register
from keepsake.sources.payloads import expand_results, extract_results

ORDER = ["file_ord", "pos"]
_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)"
SQL_CREATED = (f"CASE WHEN doc_id % 3 = 1 THEN strftime({_TS} + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00' "
               f"ELSE strftime({_TS}, '%Y-%m-%dT%H:%M:%S') || '+00:00' END")
SQL_MEDIA = ("CASE WHEN doc_id % 4 = 0 THEN 'video=https://img.example/' || CAST(doc_id AS VARCHAR) || '/high.mp4' "
             "WHEN doc_id % 3 = 0 THEN 'photo=https://img.example/' || CAST(doc_id AS VARCHAR) || '.jpg' "
             "ELSE '' END")
SQL_TEXT = "CASE WHEN doc_id % 7 = 0 THEN 'NOTE ' || text ELSE text END"

_NORMALIZED_SQL = f"""
SELECT CAST(doc_id AS VARCHAR) AS id,
       'https://x.com/' || source || '/status/' || CAST(doc_id AS VARCHAR) AS url,
       {SQL_TEXT} AS text, lang, {SQL_CREATED} AS created_at,
       source AS handle, upper(source) AS name, 'https://img.example/u/' || source AS avatar,
       CAST(n_chars % 1000 AS BIGINT) AS likes, CAST(doc_id % 5 AS BIGINT) AS retweets,
       CAST(0 AS BIGINT) AS replies, CAST(n_chars AS BIGINT) AS views,
       lang AS hashtags, source AS mentions, 'https://www.Example.com/a/' || CAST(doc_id AS VARCHAR) AS links,
       {SQL_MEDIA} AS media, (doc_id % 2 = 0) AS is_quote
FROM documents"""


def results(spark, sf_dir):
    return extract_results(D.payloads(spark, sf_dir)).select("file_ord", "path", "pos", "result")


def captures(spark, sf_dir):
    return normalize_payloads(results(spark, sf_dir), ORDER)


@register("extract_payload_results", """
SELECT doc_id // 20 AS file_ord,
       CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS INTEGER) AS pos,
       CAST(doc_id AS VARCHAR) AS id
FROM documents
UNION ALL
SELECT doc_id // 20, CAST(count(*) AS INTEGER), CAST(min(doc_id) AS VARCHAR) FROM documents GROUP BY doc_id // 20""")
def extract_payload_results_q(spark, sf_dir):
    """Every tweet_results.result in pre-order (position = arrival order)."""
    r = normalize_results(results(spark, sf_dir).select("file_ord", "pos", "result"))
    return r.select("file_ord", "pos", "id")


@register("expand_payload_results", """
SELECT doc_id // 20 AS file_ord,
       CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS INTEGER) AS pos,
       CAST(doc_id AS VARCHAR) AS id
FROM documents
UNION ALL
SELECT doc_id // 20, CAST(count(*) AS INTEGER), CAST(min(doc_id) AS VARCHAR) FROM documents GROUP BY doc_id // 20""")
def expand_payload_results_q(spark, sf_dir):
    """The same by native expressions, level by level."""
    found = expand_results(D.payloads(spark, sf_dir)).select("file_ord", "pos", "result")
    return normalize_results(found).select("file_ord", "pos", "id")


@register("normalize_posts", _NORMALIZED_SQL)
def normalize_posts_q(spark, sf_dir):
    """Raw results -> capture records: wrapper unwrapped, note text, author
    fallbacks, entities, best media, metrics, ISO dates; first id wins."""
    c = captures(spark, sf_dir)
    return c.select(
        "id", "url", "text", "lang", "created_at", F.col("author.handle").alias("handle"),
        F.col("author.name").alias("name"), F.col("author.avatar").alias("avatar"),
        F.col("metrics")["likes"].alias("likes"), F.col("metrics")["retweets"].alias("retweets"),
        F.col("metrics")["replies"].alias("replies"), F.col("metrics")["views"].alias("views"),
        F.array_join("hashtags", "|").alias("hashtags"), F.array_join("mentions", "|").alias("mentions"),
        F.array_join("links", "|").alias("links"),
        F.array_join(F.transform("media", lambda m: F.concat(m["type"], F.lit("="), m["url"])), "|").alias("media"),
        "is_quote")


@register("dedupe_payload", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CAST(CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY doc_id // 20) THEN 2 ELSE 1 END AS BIGINT) AS n_seen,
       """ + SQL_TEXT + """ AS text
FROM documents""")
def dedupe_payload_q(spark, sf_dir):
    """Ids seen twice in a page keep their first text."""
    r = normalize_results(results(spark, sf_dir).select("file_ord", "pos", "result"))
    seen = r.groupBy("id").agg(F.count("*").alias("n_seen"))
    kept = captures(spark, sf_dir).select("id", "text")
    return kept.join(seen, "id")


@register("best_variant", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 4 = 0 THEN 'video' ELSE 'photo' END AS type,
       CASE WHEN doc_id % 4 = 0 THEN 'https://img.example/' || CAST(doc_id AS VARCHAR) || '/high.mp4'
            ELSE 'https://img.example/' || CAST(doc_id AS VARCHAR) || '.jpg' END AS url
FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0""")
def best_variant_q(spark, sf_dir):
    """Highest-bitrate mp4 for videos, the still image for photos."""
    c = captures(spark, sf_dir)
    return c.select("id", F.explode("media").alias("m")).select("id", "m.type", "m.url")


@register("export_capture", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {SQL_CREATED} AS created_at,
       row_number() OVER (ORDER BY {SQL_CREATED} DESC, doc_id // 20, doc_id) - 1 AS pos
FROM documents""")
def export_capture_q(spark, sf_dir):
    """Capture export order: created_at descending, ties in first-seen order."""
    c = captures(spark, sf_dir).select("id", "created_at", *ORDER)
    ordered = order.global_position(c, [F.coalesce(F.col("created_at"), F.lit("")).desc(), *ORDER, "id"])
    return ordered.select("id", "created_at", "pos")


@register("capture_posts", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, 'https://x.com/' || source || '/status/' || CAST(doc_id AS VARCHAR) AS url,
       source AS author_handle, {SQL_TEXT} AS text, lang, CAST(n_chars AS BIGINT) AS views, 'extension' AS source
FROM documents""")
def capture_posts_q(spark, sf_dir):
    """Normalised captures as posts (what ingesting the capture file gives)."""
    p = capture_to_posts(captures(spark, sf_dir))
    return p.select("id", "url", "author_handle", "text", "lang",
                    F.col("metrics")["views"].alias("views"), "source")
