"""Listing queries: search, tag filter, counts and display formatting
(P7, P8, A7, X13, X21, X22, X23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.core import format_metric, html_escape, metric, metrics_line, search_haystack
from keepsake.operators import search as S
from keepsake.operators import search_index as SI
from keepsake.plans.registry import register
from keepsake.plans.tables import posts, table, with_posts
from keepsake.session import scratch_dir

QUERY = "  THE  And "
TAG = "en"

SQL_HAY = ("lower(coalesce(text, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(topic, '') || ' ' || "
           "coalesce(author_handle, '') || ' ' || coalesce(author_name, '') || ' ' || array_to_string(tags, ' '))")


def sql_fmt(n: str) -> str:
    """DuckDB spelling of ``format_metric`` (same exact tie rule)."""
    n = f"({n})"
    d = f"(CAST({n} AS DOUBLE) / 1000.0)"
    c = f"({d} * 134217729.0)"
    hi = f"({c} - ({c} - {d}))"
    lo = f"({d} - {hi})"
    p = f"({d} * 1000.0)"
    err = f"(({hi} * 1000.0 - {p}) + {lo} * 1000.0)"
    above = f"((({p} - CAST({n} AS DOUBLE)) + {err}) >= 0)"
    t = (f"({n} // 100 + CASE WHEN {n} % 100 = 50 THEN CASE WHEN {above} THEN 1 ELSE 0 END "
         f"WHEN {n} % 100 > 50 THEN 1 ELSE 0 END)")
    return (f"CASE WHEN {n} >= 10000 THEN CAST(({n} + 500) // 1000 AS VARCHAR) || 'k' "
            f"WHEN {n} >= 1000 THEN CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || 'k' "
            f"ELSE CAST({n} AS VARCHAR) END")


@register("search_haystack", with_posts(f"SELECT id, {SQL_HAY} AS hay FROM posts"))
def search_haystack_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", search_haystack().alias("hay"))


@register("filter_tag", with_posts(f"SELECT id FROM posts WHERE list_contains(tags, '{TAG}')"))
def filter_tag_q(spark, sf_dir):
    return S.search(posts(spark, sf_dir), tag=TAG).select("id")


@register("search_all_tokens", with_posts(
    f"SELECT id FROM posts WHERE contains({SQL_HAY}, 'the') AND contains({SQL_HAY}, 'and')"))
def search_all_tokens_q(spark, sf_dir):
    """Every whitespace token of the query (trimmed, lower-cased) must occur."""
    return S.search(posts(spark, sf_dir), q=QUERY).select("id")


@register("indexed_search", with_posts(f"""
SELECT id, 'words' AS q FROM posts WHERE contains({SQL_HAY}, 'the') AND contains({SQL_HAY}, 'and')
UNION ALL SELECT id, 'long' FROM posts WHERE contains({SQL_HAY}, 'tion') AND contains({SQL_HAY}, 'ion') AND contains({SQL_HAY}, 'the')
UNION ALL SELECT id, 'short' FROM posts WHERE contains({SQL_HAY}, 'x') AND contains({SQL_HAY}, 'en')
UNION ALL SELECT id, 'none' FROM posts WHERE contains({SQL_HAY}, 'never') AND contains({SQL_HAY}, 'qzqzq')"""))
def indexed_search_q(spark, sf_dir):
    """Several queries through the trigram index."""
    path = scratch_dir(spark) + "/index"
    SI.write_index(posts(spark, sf_dir), path, buckets=8)
    found = None
    for name, q in (("words", QUERY), ("long", "tion ion\u00a0the"), ("short", "x EN"), ("none", "never qzqzq")):
        one = SI.search(spark, path, q).select("id", F.lit(name).alias("q"))
        found = one if found is None else found.unionByName(one)
    return found


@register("search_counts", with_posts(f"""
SELECT CAST(count_if(list_contains(tags, '{TAG}') AND contains({SQL_HAY}, 'the') AND contains({SQL_HAY}, 'and')) AS BIGINT) AS shown,
       count(*) AS total FROM posts"""))
def search_counts_q(spark, sf_dir):
    return S.search_counts(posts(spark, sf_dir), q=QUERY, tag=TAG)


@register("search_by_query_column", with_posts(f"""
SELECT id FROM posts WHERE doc_id % 2 = 0 OR contains({SQL_HAY}, lower(lang))"""))
def search_by_query_column_q(spark, sf_dir):
    """Per-row queries: even posts search for '', odd ones for their language
    code (upper-case, padded)."""
    p = posts(spark, sf_dir)
    q = F.when(F.col("id").cast("bigint") % 2 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")))
    return p.where(S.match_text_column(q)).select("id")


@register("html_escape", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                        '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape_q(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_escape("html").alias("escaped"))


@register("format_metric", with_posts(f"""
SELECT id, {sql_fmt('views')} AS views_fmt, {sql_fmt('likes')} AS likes_fmt,
       {sql_fmt('views * 7 + likes')} AS mixed_fmt FROM posts"""))
def format_metric_q(spark, sf_dir):
    """k-abbreviated counts with JavaScript toFixed rounding."""
    p = posts(spark, sf_dir)
    v, lk = metric("metrics", "views"), metric("metrics", "likes")
    return p.select("id", format_metric(v).alias("views_fmt"), format_metric(lk).alias("likes_fmt"),
                    format_metric(v * 7 + lk).alias("mixed_fmt"))


@register("metrics_line", with_posts(f"""
SELECT id, concat_ws(' · ',
  CASE WHEN likes <> 0 THEN '♥ ' || {sql_fmt('likes')} END,
  CASE WHEN views <> 0 THEN '▶ ' || {sql_fmt('views')} END,
  CASE WHEN bookmarks <> 0 THEN '⌂ ' || {sql_fmt('bookmarks')} END) AS line FROM posts"""))
def metrics_line_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", metrics_line().alias("line"))
