"""Enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.core import ntz_iso
from keepsake.functions.json import build_prompt, parse_content, parse_response
from keepsake.functions.rulesets import NO_CATEGORY, SAMPLE_CATEGORIES
from keepsake.operators import enrich as E
from keepsake.plans.q_rules import SQL_HAY, SQL_HOSTS, rules_cte
from keepsake.plans.registry import register
from keepsake.plans.tables import (CONTENT_CTE, MAPPING_CTE, NOW, content, mapping, posts, table,
                                   with_posts)

_OUT = ["id", "text", "author_handle", "author_name", "created_at", "topic", "tags", "tags_source",
        "enriched", "enriched_at", "enrich_error"]


def _flat(df):
    return df.select(*[F.array_join("tags", "|").alias("tags") if c == "tags" else F.col(c) for c in _OUT],
                     F.size("media").cast("bigint").alias("n_media"))


def rules_run(spark, sf_dir):
    return E.enrich_pending(posts(spark, sf_dir), E.rules_enricher(SAMPLE_CATEGORIES), now=NOW,
                            content=content(spark, sf_dir))


# Backfill + rules, as SQL: b = posts after backfill, then rule points over b.
_RUN_CTES = [
    CONTENT_CTE,
    """b AS (
  SELECT p.*,
         (NOT p.enriched AND p.enrich_error = '') AS tgt,
         (NOT p.enriched AND p.enrich_error = '' AND p.text = '') AS need,
         c.id AS cid, c.text AS ctext, c.author_handle AS chandle, c.author_name AS cname,
         c.created_at AS ccreated, c.media_url AS cmedia
  FROM posts p LEFT JOIN content c ON c.id = p.id)""",
    """bf AS (
  SELECT id, url, hashtags, links, tags, tags_source, enriched, enriched_at, enrich_error, tgt,
         CASE WHEN need AND cid IS NULL THEN 'tweet not found' END AS ferr,
         CASE WHEN need AND cid IS NOT NULL THEN coalesce(ctext, '') ELSE text END AS text,
         CASE WHEN need AND cid IS NOT NULL AND author_handle = '' THEN chandle ELSE author_handle END AS author_handle,
         CASE WHEN need AND cid IS NOT NULL AND author_name = '' THEN cname ELSE author_name END AS author_name,
         CASE WHEN need AND cid IS NOT NULL AND created_at = '' THEN ccreated ELSE created_at END AS created_at,
         CASE WHEN need AND cid IS NOT NULL THEN 1 ELSE 0 END AS n_media
  FROM b)""",
    rules_cte(SAMPLE_CATEGORIES),
    f"hay AS (SELECT id, {SQL_HAY} AS hay, {SQL_HOSTS} AS hosts FROM bf)",
    "hosts AS (SELECT id, unnest(hosts) AS host FROM hay)",
    """kwp AS (SELECT h.id, r.category, r.ord, count(*) AS kw_points
               FROM hay h JOIN rules r ON r.kind = 'kw' AND regexp_matches(h.hay, r.pat) GROUP BY ALL)""",
    """domp AS (SELECT x.id, r.category, r.ord, 2 * count(DISTINCT r.pat) AS dom_points
                FROM hosts x JOIN rules r ON r.kind = 'dom' AND (x.host = r.pat OR ends_with(x.host, '.' || r.pat))
                GROUP BY ALL)""",
    """points AS (SELECT coalesce(k.id, d.id) AS id, coalesce(k.category, d.category) AS category,
                         coalesce(k.ord, d.ord) AS ord, coalesce(k.kw_points, 0) + coalesce(d.dom_points, 0) AS score
                  FROM kwp k FULL OUTER JOIN domp d ON k.id = d.id AND k.ord = d.ord)""",
    "cats AS (SELECT id, list(category ORDER BY score DESC, ord) AS cats FROM points WHERE score > 0 GROUP BY id)",
    f"""res AS (
  SELECT bf.*, (tgt AND ferr IS NULL) AS ok, (tgt AND ferr IS NOT NULL) AS failed,
         coalesce(c.cats[1], '{NO_CATEGORY}') AS r_topic,
         coalesce(c.cats, ['{NO_CATEGORY}']) AS r_tags
  FROM bf LEFT JOIN cats c ON c.id = bf.id)""",
    f"""run AS (
  SELECT id, text, author_handle, author_name, created_at,
         CASE WHEN ok THEN r_topic ELSE '' END AS topic,
         array_to_string(CASE WHEN ok AND tags_source <> 'manual' THEN r_tags ELSE tags END, '|') AS tags,
         CASE WHEN ok AND tags_source <> 'manual' THEN 'auto' ELSE tags_source END AS tags_source,
         CASE WHEN ok THEN true ELSE enriched END AS enriched,
         CASE WHEN ok THEN '{NOW}' ELSE enriched_at END AS enriched_at,
         CASE WHEN ok THEN '' WHEN failed THEN ferr ELSE enrich_error END AS enrich_error,
         CAST(n_media AS BIGINT) AS n_media,
         CASE WHEN ok THEN 'enriched' WHEN failed THEN 'error' END AS status
  FROM res)""",
]


@register("enrich_pending", with_posts(
    "SELECT id, text, author_handle, author_name, created_at, topic, tags, tags_source, enriched, "
    "enriched_at, enrich_error, n_media FROM run", *_RUN_CTES))
def enrich_pending_q(spark, sf_dir):
    """Rule enrichment of pending posts, empty texts backfilled from content."""
    return _flat(rules_run(spark, sf_dir))


@register("enrich_stats", with_posts(
    "SELECT CAST(count_if(status = 'enriched') AS BIGINT) AS enriched, CAST(count_if(status = 'error') AS BIGINT) AS errors FROM run",
    *_RUN_CTES))
def enrich_stats_q(spark, sf_dir):
    return E.enrich_stats(rules_run(spark, sf_dir))


@register("enrich_idempotent", "SELECT CAST(0 AS BIGINT) AS enriched, CAST(0 AS BIGINT) AS errors")
def enrich_idempotent_q(spark, sf_dir):
    """A second run over the first run's output has nothing left to do."""
    first = E.drop_status(rules_run(spark, sf_dir))
    second = E.enrich_pending(first, E.rules_enricher(SAMPLE_CATEGORIES), now=NOW,
                              content=content(spark, sf_dir))
    return E.enrich_stats(second)


@register("backfill_content", with_posts(
    "SELECT id, text, author_handle, author_name, created_at, n_media, enrich_error FROM run "
    "WHERE id IN (SELECT id FROM b WHERE need)", *_RUN_CTES))
def backfill_content_q(spark, sf_dir):
    """Rows that needed text: fetched where content exists, else 'tweet not found'."""
    need = E.pending(posts(spark, sf_dir)).where(F.col("text") == "").select("id")
    out = _flat(rules_run(spark, sf_dir))
    return out.join(need, "id", "left_semi").select("id", "text", "author_handle", "author_name",
                                                     "created_at", "n_media", "enrich_error")


# -- offline mapping (apply) ----------------------------------------------------

_APPLY_CTES = [
    MAPPING_CTE,
    """m AS (SELECT id, regexp_replace(summary, '^\\s+|\\s+$', '', 'g') AS summary,
                    regexp_replace(topic, '^\\s+|\\s+$', '', 'g') AS topic,
                    list_filter(list_transform(tags, lambda t: lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))), lambda t: t <> '') AS tags
             FROM mapping)""",
    f"""ap AS (
  SELECT p.id, p.tags_source AS old_source, p.tags AS old_tags, p.summary AS old_summary, p.topic AS old_topic,
         p.enriched AS old_enriched, p.enriched_at AS old_at, p.enrich_error AS old_error,
         (NOT p.enriched AND p.enrich_error = '') AS tgt,
         CASE WHEN p.text = '' THEN 'fetch disabled; record is missing text'
              WHEN m.id IS NULL THEN 'no enrichment provided for this id' END AS err,
         m.summary, m.topic, m.tags
  FROM posts p LEFT JOIN m ON m.id = p.id)""",
    f"""applied AS (
  SELECT id,
         CASE WHEN tgt AND err IS NULL THEN summary ELSE old_summary END AS summary,
         CASE WHEN tgt AND err IS NULL THEN topic ELSE old_topic END AS topic,
         array_to_string(CASE WHEN tgt AND err IS NULL AND old_source <> 'manual' THEN tags ELSE old_tags END, '|') AS tags,
         CASE WHEN tgt AND err IS NULL AND old_source <> 'manual' THEN 'auto' ELSE old_source END AS tags_source,
         CASE WHEN tgt AND err IS NULL THEN true ELSE old_enriched END AS enriched,
         CASE WHEN tgt AND err IS NULL THEN '{NOW}' ELSE old_at END AS enriched_at,
         CASE WHEN tgt AND err IS NULL THEN '' WHEN tgt THEN err ELSE old_error END AS enrich_error
  FROM ap)""",
]


def apply_run(spark, sf_dir):
    return E.enrich_pending(posts(spark, sf_dir), E.mapping_enricher(mapping(spark, sf_dir)), now=NOW,
                            offline=True)


@register("apply_enrichment", with_posts("SELECT * FROM applied", *_APPLY_CTES))
def apply_enrichment_q(spark, sf_dir):
    """Offline apply: mapping results written back, manual tags protected."""
    return apply_run(spark, sf_dir).select(
        "id", "summary", "topic", F.array_join("tags", "|").alias("tags"), "tags_source", "enriched",
        "enriched_at", "enrich_error")


@register("apply_mapping_errors", with_posts(
    "SELECT id, enrich_error FROM applied WHERE enrich_error = 'no enrichment provided for this id'",
    *_APPLY_CTES))
def apply_mapping_errors_q(spark, sf_dir):
    r = apply_run(spark, sf_dir)
    return r.where(F.col("enrich_error") == E.NO_MAPPING).select("id", "enrich_error")


@register("normalize_mapping", with_posts(
    "SELECT id, summary, topic, array_to_string(tags, '|') AS tags FROM m", *_APPLY_CTES))
def normalize_mapping_q(spark, sf_dir):
    m = mapping(spark, sf_dir)
    n = m.select("id", E.normalize_result(F.col("summary"), F.col("topic"), F.col("tags")).alias("r"))
    return n.select("id", "r.summary", "r.topic", F.array_join("r.tags", "|").alias("tags"))


# -- prompts, responses, fetched content -----------------------------------------------


@register("build_prompts", with_posts("""
SELECT id, CASE WHEN author_handle <> '' THEN trim('Author: @' || author_handle || ' (' || author_name || ')') || chr(10)
                ELSE '' END || 'URL: ' || url || chr(10) || 'Text: ' || text AS prompt FROM posts"""))
def build_prompts_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", build_prompt().alias("prompt"))


def responses(spark, sf_dir):
    """Model responses built from assistant turns (see FIXTURES.md §3)."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    summary = F.regexp_replace(F.col("text"), r"[^\p{L}\p{N} ]", "")
    body = F.concat(F.lit('{"summary": "'), summary, F.lit('", "topic": " t'), (F.col("turn") % 4).cast("string"),
                    F.lit(' ", "tags": [" Conv'), F.col("conv_id").cast("string"), F.lit(' ", "TURN'),
                    F.col("turn").cast("string"), F.lit('", " ", '), F.col("turn").cast("string"), F.lit("]}"))
    body = F.when(F.col("conv_id") % 10 == 0, F.left(body, F.lit(20))).otherwise(body)
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                    text.alias("response"))


@register("parse_responses", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
       CASE WHEN conv_id % 10 = 0 THEN NULL
            ELSE regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N} ]', '', 'g'), '^\\s+|\\s+$', '', 'g') END AS summary,
       CASE WHEN conv_id % 10 = 0 THEN NULL ELSE 't' || CAST(turn % 4 AS VARCHAR) END AS topic,
       CASE WHEN conv_id % 10 = 0 THEN NULL
            ELSE 'conv' || CAST(conv_id AS VARCHAR) || '|turn' || CAST(turn AS VARCHAR) || '|' || CAST(turn AS VARCHAR) END AS tags,
       CASE WHEN conv_id % 10 = 0 THEN 'invalid response: not a JSON object' END AS error
FROM conversations WHERE role = 'assistant'""")
def parse_responses_q(spark, sf_dir):
    r = responses(spark, sf_dir).select("id", parse_response(F.col("response")).alias("r"))
    return r.select("id", "r.summary", "r.topic", F.array_join("r.tags", "|").alias("tags"), "r.error")


@register("parse_content", """
SELECT CAST(doc_id AS VARCHAR) AS id, text, 'u' || source AS author_handle, upper(source) AS author_name,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S') AS created_at,
       CASE WHEN doc_id % 3 = 0 THEN 'photo=https://media.example/' || CAST(doc_id AS VARCHAR) || '.jpg'
            ELSE '' END AS media
FROM documents""")
def parse_content_q(spark, sf_dir):
    """Raw fetched-content JSON (built per document) parsed back to fields."""
    d = table(spark, sf_dir, "documents")
    media = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(
        F.lit("photo").alias("type"),
        F.concat(F.lit("https://media.example/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("media_url_https")))
    ).otherwise(F.array().cast("array<struct<type:string,media_url_https:string>>"))
    raw = F.to_json(F.struct(
        F.col("text"),
        F.struct(F.concat(F.lit("u"), F.col("source")).alias("screen_name"), F.upper("source").alias("name")).alias("user"),
        ntz_iso(F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '1' minute")).alias("created_at"),
        media.alias("mediaDetails")))
    p = d.select(F.col("doc_id").cast("string").alias("id"), parse_content(raw).alias("c"))
    return p.select("id", "c.text", "c.author_handle", "c.author_name", "c.created_at",
                    F.array_join(F.transform("c.media", lambda m: F.concat(m["type"], F.lit("="), m["url"])), "|")
                    .alias("media"))


# -- user-function enricher ------------------------------------------------------------------


def sample_udf_enricher(row: dict) -> dict:
    """Example plug-in: the words of the text as summary; fails on texts without 'e'."""
    text = row.get("text") or ""
    if "e" not in text:
        raise ValueError("no e in text")
    return {"summary": " ".join(text.split()), "topic": row.get("lang") or "",
            "tags": [row.get("author_handle") or "anon"]}


@register("enrich_with_udf", with_posts(f"""
SELECT id,
  CASE WHEN NOT enriched AND enrich_error = '' AND text <> '' AND NOT contains(text, 'e')
       THEN 'no e in text'
       WHEN NOT enriched AND enrich_error = '' AND text = '' THEN 'fetch disabled; record is missing text'
       ELSE enrich_error END AS enrich_error,
  CASE WHEN NOT enriched AND enrich_error = '' AND contains(text, 'e')
       THEN array_to_string(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), ' ')
       ELSE summary END AS summary,
  CASE WHEN NOT enriched AND enrich_error = '' AND contains(text, 'e') AND tags_source <> 'manual'
       THEN CASE WHEN author_handle = '' THEN 'anon' ELSE author_handle END
       ELSE array_to_string(tags, '|') END AS tags,
  CASE WHEN NOT enriched AND enrich_error = '' AND contains(text, 'e') THEN true ELSE enriched END AS enriched
FROM posts"""))
def enrich_with_udf_q(spark, sf_dir):
    """A Python enricher through mapInPandas with per-row error isolation."""
    r = E.enrich_pending(posts(spark, sf_dir), E.udf_enricher(sample_udf_enricher), now=NOW, offline=True)
    return r.select("id", "enrich_error", "summary", F.array_join("tags", "|").alias("tags"), "enriched")


_LIMIT = 25


@register("enrich_limit", with_posts(f"""
SELECT p.id, CASE WHEN t.id IS NOT NULL AND t.text <> '' THEN true ELSE p.enriched END AS enriched,
       CASE WHEN t.id IS NULL THEN p.enrich_error WHEN t.text = '' THEN 'fetch disabled; record is missing text'
            ELSE '' END AS enrich_error
FROM posts p LEFT JOIN (SELECT id, text FROM posts WHERE NOT enriched AND enrich_error = '' ORDER BY id LIMIT {_LIMIT}) t
  ON p.id = t.id"""))
def enrich_limit_q(spark, sf_dir):
    """A run limited to the first pending ids; every other row stays as it is."""
    r = E.enrich_pending(posts(spark, sf_dir), E.rules_enricher(), now=NOW, offline=True, limit=_LIMIT)
    return r.select("id", "enriched", "enrich_error")


@register("enrich_from_responses", with_posts("""
SELECT p.id, CASE WHEN p.doc_id % 10 = 3 THEN p.enriched ELSE true END AS enriched,
       CASE WHEN p.doc_id % 10 = 3 THEN 'invalid response: not a JSON object' ELSE '' END AS enrich_error,
       CASE WHEN p.doc_id % 10 = 3 THEN p.topic ELSE p.lang END AS topic
FROM posts p WHERE NOT p.enriched AND p.enrich_error = ''"""))
def enrich_from_responses_q(spark, sf_dir):
    """Model responses parsed and applied; a response that isn't JSON becomes that row's error."""
    p = E.pending(posts(spark, sf_dir))
    body = F.to_json(F.struct(F.col("text").alias("summary"), F.col("lang").alias("topic"), F.array("source").alias("tags")))
    answers = p.select("id", F.when(F.col("id").cast("bigint") % 10 == 3, F.lit("no answer")).otherwise(body).alias("response"))
    r = E.enrich_pending(p, E.response_enricher(answers), now=NOW)
    return r.select("id", "enriched", "enrich_error", "topic")
