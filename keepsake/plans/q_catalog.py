"""Catalog, facet and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.core import catalog_title, safe_url
from keepsake.operators import catalog as cat
from keepsake.plans.registry import register
from keepsake.plans.tables import posts, with_posts

# DuckDB spellings of the shared column rules.
SQL_SAFE_URL = "CASE WHEN starts_with(lower(coalesce(url, '')), 'http://') OR starts_with(lower(coalesce(url, '')), 'https://') THEN url ELSE '#' END"
SQL_TITLE = ("regexp_replace(replace(coalesce(nullif(summary, ''), nullif(text, ''), nullif(url, ''), ''), chr(10), ' '), "
             "'^\\s+|\\s+$', '', 'g')")
SQL_LINE = ("'- ' || CASE WHEN author_handle <> '' THEN '@' || author_handle || ' — ' ELSE '' END "
            f"|| '[' || {SQL_TITLE} || '](' || {SQL_SAFE_URL} || ') `#' || id || '`'")
SQL_BY_TAG = "FROM posts, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['untagged'] END) AS t(tag)"


def catalog_lines_df(spark, sf_dir):
    return cat.catalog_entries(posts(spark, sf_dir))


register("catalog_lines", with_posts(f"SELECT tag, id, {SQL_LINE} AS line {SQL_BY_TAG}"))(catalog_lines_df)


@register("by_tag", with_posts(f"SELECT tag, id {SQL_BY_TAG}"))
def by_tag_q(spark, sf_dir):
    return cat.by_tag(posts(spark, sf_dir)).select("tag", "id")


@register("catalog_header", with_posts(
    "SELECT count(*) AS n_posts, CAST(count(*) AS VARCHAR) || ' bookmarks.' AS header FROM posts"))
def catalog_header_q(spark, sf_dir):
    return cat.catalog_header(posts(spark, sf_dir))


@register("catalog_sections", with_posts(
    f"SELECT tag, count(*) AS n_entries, min(id) AS first_id, max(id) AS last_id {SQL_BY_TAG} GROUP BY tag"))
def catalog_sections_q(spark, sf_dir):
    """Section sizes and id range per tag (entries of one section are id-sorted)."""
    return (cat.by_tag(posts(spark, sf_dir)).groupBy("tag")
            .agg(F.count("*").alias("n_entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))


@register("tag_facet", with_posts("SELECT DISTINCT tag FROM posts, unnest(tags) AS t(tag)"))
def tag_facet_q(spark, sf_dir):
    return cat.tag_facet(posts(spark, sf_dir))


@register("safe_url", with_posts(f"SELECT id, url, {SQL_SAFE_URL} AS safe FROM posts"))
def safe_url_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "url", safe_url("url").alias("safe"))


@register("catalog_title", with_posts(f"SELECT id, {SQL_TITLE} AS title FROM posts"))
def catalog_title_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", catalog_title().alias("title"))


_PUBLIC_SQL = f"""
SELECT id, {SQL_SAFE_URL} AS url, text, summary, topic, array_to_string(tags, '|') AS tags,
       author_handle, author_name, created_at,
       CAST(likes AS BIGINT) AS likes, CAST(views AS BIGINT) AS views, CAST(bookmarks AS BIGINT) AS bookmarks
FROM posts"""


@register("public_fields", with_posts(_PUBLIC_SQL))
def public_fields_q(spark, sf_dir):
    rec = cat.public_records(posts(spark, sf_dir))
    m = F.col("metrics")
    return rec.select("id", "url", "text", "summary", "topic", F.array_join("tags", "|").alias("tags"),
                      "author_handle", "author_name", "created_at",
                      F.try_element_at(m, F.lit("likes")).cast("bigint").alias("likes"),
                      F.try_element_at(m, F.lit("views")).cast("bigint").alias("views"),
                      F.try_element_at(m, F.lit("bookmarks")).cast("bigint").alias("bookmarks"))


_PAYLOAD_SQL = f"""
SELECT id, replace(
  '{{"id":' || to_json(id) || ',"url":' || to_json({SQL_SAFE_URL}) || ',"text":' || to_json(text)
  || ',"summary":' || to_json(summary) || ',"topic":' || to_json(topic) || ',"tags":' || to_json(tags)
  || ',"author_handle":' || to_json(author_handle) || ',"author_name":' || to_json(author_name)
  || ',"created_at":' || to_json(created_at)
  || ',"metrics":{{"bookmarks":' || CAST(bookmarks AS VARCHAR) || ',"likes":' || CAST(likes AS VARCHAR)
  || ',"views":' || CAST(views AS VARCHAR) || '}}}}', '<', '\\u003c') AS json
FROM posts"""


@register("public_payload", with_posts(_PAYLOAD_SQL))
def public_payload_q(spark, sf_dir):
    return cat.public_payload_lines(posts(spark, sf_dir))


@register("catalog_document", with_posts(f"""
SELECT NULL::VARCHAR AS tag, 0 AS row, '' AS id, '# Bookmarks catalog' AS line
UNION ALL SELECT NULL, 1, '', CAST(count(*) AS VARCHAR) || ' bookmarks.' FROM posts
UNION ALL SELECT DISTINCT tag, 0, '', '## ' || tag {SQL_BY_TAG}
UNION ALL SELECT tag, 1, id, {SQL_LINE} {SQL_BY_TAG}"""))
def catalog_document_q(spark, sf_dir):
    """Every line of the catalog with its place: title, total, headings, posts."""
    return cat.catalog_document(posts(spark, sf_dir))
