"""Input tables of the driver's data set and the deterministic adapters over them.

Every adapter exists twice: as a DataFrame plan (used by the library queries)
and as a DuckDB CTE (used by the oracle SQL).  Both derive the same rows from
the driver tables so the two engines can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.schema import conform_posts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minutes_after_2024(minutes_col: str) -> F.Column:
    from keepsake.functions.core import ntz_iso
    return ntz_iso(F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + {minutes_col} * interval '1' minute"))


# -- posts --------------------------------------------------------------------


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per document (see FIXTURES.md §3)."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    n_pages = pages.select(F.count("*")).scalar()
    link = pages.select("page_id", F.col("url").alias("page_url"))
    d = F.col("doc_id")
    joined = docs.join(link, F.try_mod(d, n_pages) == F.col("page_id"), "left")
    df = joined.select(
        d.cast("string").alias("id"),
        F.when(d % 13 == 0, F.lit("javascript:x"))
        .otherwise(F.concat(F.lit("https://posts.example/"), F.col("source"), F.lit("/status/"),
                            d.cast("string"))).alias("url"),
        F.when(d % 9 == 0, F.lit("")).otherwise(F.col("source")).alias("author_handle"),
        F.upper(F.col("source")).alias("author_name"),
        F.when(d % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.col("lang"),
        _minutes_after_2024("doc_id").alias("created_at"),
        F.array(F.col("lang")).alias("hashtags"),
        F.when(F.col("page_url").isNotNull(), F.array(F.col("page_url")))
        .otherwise(F.array().cast("array<string>")).alias("links"),
        F.create_map(F.lit("likes"), F.col("n_chars") % 1000,
                     F.lit("views"), F.col("n_chars"),
                     F.lit("bookmarks"), d % 7).alias("metrics"),
        F.when(d % 10 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.col("lang"), F.col("source"))).alias("tags"),
        F.when(d % 11 == 0, F.lit("manual")).otherwise(F.lit("")).alias("tags_source"),
        (d % 3 == 0).alias("enriched"),
        F.when((d % 5 == 1) & (d % 3 != 0), F.lit("boom")).otherwise(F.lit("")).alias("enrich_error"),
        F.lit("json-export").alias("source"),
    )
    return conform_posts(df)


POSTS_CTE = """
posts AS (
  SELECT
    CAST(d.doc_id AS VARCHAR) AS id,
    CASE WHEN d.doc_id % 13 = 0 THEN 'javascript:x'
         ELSE 'https://posts.example/' || d.source || '/status/' || CAST(d.doc_id AS VARCHAR) END AS url,
    CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE d.source END AS author_handle,
    upper(d.source) AS author_name,
    CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE d.text END AS text,
    d.lang AS lang,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%S') AS created_at,
    [d.lang] AS hashtags,
    CASE WHEN p.url IS NULL THEN []::VARCHAR[] ELSE [p.url] END AS links,
    d.n_chars % 1000 AS likes,
    d.n_chars AS views,
    d.doc_id % 7 AS bookmarks,
    CASE WHEN d.doc_id % 10 = 0 THEN []::VARCHAR[] ELSE [d.lang, d.source] END AS tags,
    CASE WHEN d.doc_id % 11 = 0 THEN 'manual' ELSE '' END AS tags_source,
    (d.doc_id % 3 = 0) AS enriched,
    CASE WHEN d.doc_id % 5 = 1 AND d.doc_id % 3 <> 0 THEN 'boom' ELSE '' END AS enrich_error,
    'json-export' AS source,
    '' AS summary,
    '' AS topic,
    '' AS enriched_at,
    d.doc_id AS doc_id
  FROM documents d
  LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
)"""


def with_posts(sql: str, *more_ctes: str) -> str:
    ctes = ",\n".join((POSTS_CTE.strip(),) + tuple(c.strip() for c in more_ctes))
    return f"WITH {ctes}\n{sql.strip()}"


def _doc_id() -> F.Column:
    return F.col("id").cast("bigint")


# -- incoming batch (additive ingest) -------------------------------------------

NEW_ID_OFFSET = 1_000_000


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even posts again (already stored) plus each one under a new id, twice.

    The new id arrives at positions 1 and 2 with different text; position 1
    must win.  Columns: post columns + ``batch`` + ``pos``.
    """
    p = posts(spark, sf_dir).where(_doc_id() % 2 == 0)
    doc = _doc_id()
    new_id = (doc + NEW_ID_OFFSET).cast("string")
    again = p.withColumn("batch", F.lit(0)).withColumn("pos", doc * 3)
    # pos is computed from the original id before the id is replaced
    first = p.withColumn("batch", F.lit(0)).withColumn("pos", doc * 3 + 1).withColumn("id", new_id)
    second = (p.withColumn("text", F.concat(F.lit("copy: "), F.col("text")))
              .withColumn("batch", F.lit(0)).withColumn("pos", doc * 3 + 2).withColumn("id", new_id))
    return again.unionByName(first).unionByName(second)


# -- changes (upsert) -----------------------------------------------------------


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with doc_id % 4 = 0 in two versions (seq 0 stale, seq 1 final)."""
    p = posts(spark, sf_dir).where(_doc_id() % 4 == 0)
    stale = p.withColumn("summary", F.lit("stale")).withColumn("seq", F.lit(0))
    final = p.withColumn("summary", F.concat(F.lit("updated "), F.col("id"))).withColumn("seq", F.lit(1))
    return stale.unionByName(final)


# -- content (backfill) and mapping (apply) -------------------------------------

CONTENT_MODULUS = 34
NOW = "2025-01-01T00:00:00+00:00"


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched content for half of the empty-text posts (doc_id % 34 = 0)."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % CONTENT_MODULUS == 0)
    media = F.array(F.struct(F.lit(None).cast("string").alias("thumb"), F.lit("photo").alias("type"),
                             F.concat(F.lit("https://media.example/"), F.col("doc_id").cast("string")).alias("url")))
    return d.select(F.col("doc_id").cast("string").alias("id"), "text",
                    F.concat(F.lit("fetched_"), F.col("source")).alias("author_handle"),
                    F.concat(F.lit("Fetched "), F.col("source")).alias("author_name"),
                    F.lit("2023-06-01T00:00:00").alias("created_at"), media.alias("media"))


CONTENT_CTE = """
content AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text, 'fetched_' || source AS author_handle,
         'Fetched ' || source AS author_name, '2023-06-01T00:00:00' AS created_at,
         'https://media.example/' || CAST(doc_id AS VARCHAR) AS media_url
  FROM documents WHERE doc_id % 34 = 0
)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-produced enrichment for even doc_ids: (id, summary, topic, tags)."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == 0)
    return d.select(F.col("doc_id").cast("string").alias("id"),
                    F.col("text").alias("summary"),
                    F.col("lang").alias("topic"),
                    F.array(F.upper(F.col("lang")), F.lit(" "), F.col("source")).alias("tags"))


MAPPING_CTE = """
mapping AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS summary, lang AS topic,
         [upper(lang), ' ', source] AS tags
  FROM documents WHERE doc_id % 2 = 0
)"""
