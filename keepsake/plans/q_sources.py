"""Source/format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.core import (coerce_metrics, extract_id, metric, ntz_iso, ntz_rfc, ntz_x_style,
                                     parse_created_at)
from keepsake.plans import documents as D
from keepsake.plans.registry import register
from keepsake.plans.tables import posts, table, with_posts
from keepsake.schema import conform_posts
from keepsake.session import scratch_dir
from keepsake.sources import exports as X
from keepsake.sources.ndjson import read_posts, to_json_lines, write_posts

SQL_ISO = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%dT%H:%M:%S')"
SQL_XURL = ("CASE WHEN doc_id % 13 = 0 THEN 'javascript:x' "
            "ELSE 'https://x.com/' || source || '/status/' || CAST(doc_id AS VARCHAR) END")
# The id a flat/rich export item resolves to ('' = dropped).
SQL_ITEM_ID = ("CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR) "
               "WHEN doc_id % 9 = 0 OR doc_id % 13 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END")
SQL_POS = "CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS INTEGER)"

_EXPORT_SQL = f"""
WITH e AS (
  SELECT doc_id // 20 AS file_ord, {SQL_POS} AS pos, doc_id, {SQL_ITEM_ID} AS id,
         CASE WHEN doc_id % 9 = 0 THEN 'https://x.com/i/status/' || CAST(doc_id AS VARCHAR) ELSE {SQL_XURL} END AS url,
         source AS author_handle, upper(source) AS author_name, text, {SQL_ISO} AS created_at,
         CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_media
  FROM documents)
SELECT file_ord, pos, id, url, author_handle, author_name, text, created_at, n_media,
       'json-export' AS source
FROM e WHERE id <> ''"""


def _flat_posts(df, *extra):
    return df.select("file_ord", "pos", "id", "url", "author_handle", "author_name", "text", "created_at",
                     F.size("media").cast("bigint").alias("n_media"), *extra, "source")


@register("scan_json_export", _EXPORT_SQL)
def scan_json_export_q(spark, sf_dir):
    """Flat exports: envelopes, junk items skipped, id from URL, default URL."""
    return _flat_posts(X.posts_from_documents(D.export_documents(spark, sf_dir), X.JSON_EXPORT))


_RICH_SQL = f"""
WITH e AS (
  SELECT (doc_id // 20) + 1048576 AS file_ord, {SQL_POS} AS pos, doc_id,
         CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS VARCHAR)
              WHEN doc_id % 13 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
         {SQL_XURL} AS url, source AS author_handle, upper(source) AS author_name, text,
         CASE WHEN doc_id % 6 = 0 THEN NULL ELSE {SQL_ISO} END AS created_at,
         CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0 END AS BIGINT) AS n_media,
         lang, CAST(n_chars % 1000 AS BIGINT) AS likes, CAST(n_chars AS BIGINT) AS views,
         CAST(2 AS BIGINT) AS ratio, CAST(3 AS BIGINT) AS n_metrics, lang AS hashtags
  FROM documents)
SELECT file_ord, pos, id, url, author_handle, author_name, text, created_at, n_media,
       lang, likes, views, ratio, n_metrics, hashtags, 'extension' AS source
FROM e WHERE id <> ''"""


@register("scan_rich_capture", _RICH_SQL)
def scan_rich_capture_q(spark, sf_dir):
    """Rich captures: nested author, metric coercion, null created_at kept."""
    p = X.posts_from_documents(D.rich_documents(spark, sf_dir), X.EXTENSION)
    return _flat_posts(p, "lang", metric("metrics", "likes").alias("likes"), metric("metrics", "views").alias("views"),
                       metric("metrics", "ratio").alias("ratio"), F.size("metrics").cast("bigint").alias("n_metrics"),
                       F.array_join("hashtags", "|").alias("hashtags"))


_URLS_SQL = f"""
WITH e AS (
  SELECT (doc_id // 20) + 2097152 AS file_ord, {SQL_POS} AS pos, doc_id, CAST(doc_id AS VARCHAR) AS id,
         'https://x.com/' || source || '/status/' || CAST(doc_id AS VARCHAR) AS url
  FROM documents)
SELECT file_ord, pos, id, url, 'url-list' AS source FROM e WHERE doc_id % 13 <> 0"""


@register("scan_url_list", _URLS_SQL)
def scan_url_list_q(spark, sf_dir):
    """URL lists: text lines (any Unicode line break) or JSON arrays."""
    p = X.posts_from_documents(D.url_list_documents(spark, sf_dir), X.URL_LIST)
    return p.select("file_ord", "pos", "id", "url", "source")


_GROUPS = "(SELECT DISTINCT doc_id // 20 AS g FROM documents)"


@register("detect_format", f"""
SELECT 'export/' || CAST(g AS VARCHAR) AS path, 'json-export' AS format FROM {_GROUPS}
UNION ALL SELECT 'rich/' || CAST(g AS VARCHAR), 'extension' FROM {_GROUPS}
UNION ALL SELECT 'urls/' || CAST(g AS VARCHAR), 'url-list' FROM {_GROUPS}""")
def detect_format_q(spark, sf_dir):
    docs = D.mixed_documents(spark, sf_dir)
    return docs.select("path", X.detect_format(F.try_parse_json("value")).alias("format"))


@register("shape_predicate", f"""
SELECT 'export/' || CAST(g AS VARCHAR) AS path, false AS rich FROM {_GROUPS}
UNION ALL SELECT 'rich/' || CAST(g AS VARCHAR), true FROM {_GROUPS}
UNION ALL SELECT 'urls/' || CAST(g AS VARCHAR), false FROM {_GROUPS}""")
def shape_predicate_q(spark, sf_dir):
    docs = D.mixed_documents(spark, sf_dir)
    doc = F.try_parse_json("value")
    items = X.rich_items(doc)
    return docs.select("path", F.coalesce(X.looks_like_rich(items), F.lit(False)).alias("rich"))


@register("objects_only", """
SELECT 'export/' || CAST(doc_id // 20 AS VARCHAR) AS path,
       CAST(count(*) + CASE WHEN (doc_id // 20) % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_items,
       CAST(count(*) AS INTEGER) AS n_objects
FROM documents GROUP BY doc_id // 20""")
def objects_only_q(spark, sf_dir):
    """Items per export file and how many are objects (the rest are skipped)."""
    from keepsake.functions.variant import as_array, is_object
    docs = D.export_documents(spark, sf_dir)
    items = as_array(X.export_items(F.parse_json("value")))
    return docs.select("path", F.size(items).alias("n_items"),
                       F.size(F.filter(items, lambda it: is_object(it))).alias("n_objects"))


@register("ingest_union", f"""
SELECT id, source FROM ({_EXPORT_SQL})
UNION ALL SELECT id, source FROM ({_RICH_SQL})
UNION ALL SELECT id, source FROM ({_URLS_SQL})""")
def ingest_union_q(spark, sf_dir):
    """All formats read in one pass: format detected per file, unioned."""
    p = X.posts_from_documents(D.mixed_documents(spark, sf_dir))
    return p.select("id", "source")


@register("extract_id", with_posts(
    "SELECT id, url, regexp_extract(url, '/status/([0-9]+)', 1) AS status_id FROM posts"))
def extract_id_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "url", extract_id("url").alias("status_id"))


@register("conform_schema", """
SELECT CAST(doc_id AS VARCHAR) AS id, '' AS author_handle, CAST(0 AS INTEGER) AS n_tags, false AS enriched,
       '' AS tags_source, '' AS created_at, CAST(22 AS INTEGER) AS n_fields
FROM documents""")
def conform_schema_q(spark, sf_dir):
    """Known-fields projection: unknown columns dropped, defaults filled."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("https://x.com/i/status/1").alias("url"),
        F.col("text"), F.col("n_chars").alias("unknown_column"))
    c = conform_posts(d)
    return c.select("id", "author_handle", F.size("tags").alias("n_tags"), "enriched", "tags_source",
                    "created_at", F.lit(len(c.columns)).alias("n_fields"))


# -- NDJSON store round trip ------------------------------------------------------------


@register("scan_ndjson", with_posts("""
SELECT id, url, CASE WHEN doc_id % 5 = 0 THEN 'v2 ' || text ELSE text END AS text, author_handle, created_at,
       array_to_string(tags, '|') AS tags, CAST(likes AS BIGINT) AS likes
FROM posts"""))
def scan_ndjson_q(spark, sf_dir):
    """Write the posts as NDJSON twice (second file: new text for every fifth
    post), read both back: the later line of an id wins."""
    base = scratch_dir(spark)
    p = posts(spark, sf_dir)
    write_posts(p, base + "/a")
    v2 = p.where(F.col("id").cast("bigint") % 5 == 0).withColumn("text", F.concat(F.lit("v2 "), F.col("text")))
    write_posts(v2, base + "/b")
    back = read_posts(spark, [base + "/a", base + "/b"])
    return back.select("id", "url", "text", "author_handle", "created_at", F.array_join("tags", "|").alias("tags"),
                       metric("metrics", "likes").alias("likes"))


_JSON_LINE_SQL = with_posts("""
SELECT id, '{' ||
  '"author_handle":' || to_json(author_handle) || ',"author_name":' || to_json(author_name) ||
  ',"created_at":' || to_json(created_at) || ',"enrich_error":' || to_json(enrich_error) ||
  ',"enriched":' || CASE WHEN enriched THEN 'true' ELSE 'false' END ||
  ',"enriched_at":' || to_json(enriched_at) || ',"hashtags":' || to_json(hashtags) ||
  ',"id":' || to_json(id) || ',"imported_at":""' || ',"lang":' || to_json(lang) ||
  ',"links":' || to_json(links) || ',"media":[],"mentions":[]' ||
  ',"metrics":{"bookmarks":' || CAST(bookmarks AS VARCHAR) || ',"likes":' || CAST(likes AS VARCHAR) ||
  ',"views":' || CAST(views AS VARCHAR) || '}' ||
  ',"source":' || to_json(source) || ',"summary":' || to_json(summary) || ',"tags":' || to_json(tags) ||
  ',"tags_source":' || to_json(tags_source) || ',"text":' || to_json(text) || ',"thread_ids":[]' ||
  ',"topic":' || to_json(topic) || ',"url":' || to_json(url) || '}' AS value
FROM posts""")


@register("to_ndjson_lines", _JSON_LINE_SQL)
def to_ndjson_lines_q(spark, sf_dir):
    """Deterministic store line: keys sorted, every field present."""
    return to_json_lines(posts(spark, sf_dir))


# -- coercion and dates ----------------------------------------------------------------


@register("coerce_metrics", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(1 AS BIGINT) AS t,
       CAST(12 AS BIGINT) AS s, CAST(3 AS BIGINT) AS f, CAST(-2 AS BIGINT) AS neg, CAST(5 AS INTEGER) AS n_keys
FROM events""")
def coerce_metrics_q(spark, sf_dir):
    """Only int-convertible values survive: true->1, "12"->12, 3.9->3,
    -2.7->-2; HTML strings, "3.7", null and objects are dropped."""
    ev = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"),
                   F.lit(', "t": true, "s": " 12 ", "f": 3.9, "neg": -2.7, "h": "<b>x</b>", "d": "3.7", '
                         '"n": null, "o": {"a": 1}}'))
    m = ev.select("event_id", coerce_metrics(F.parse_json(raw)).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("k", "t", "s", "f", "neg")],
                    F.size("m").alias("n_keys"))


@register("parse_created_at", """
SELECT event_id,
  CASE event_id % 3
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
    WHEN 1 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'
    ELSE CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' END AS iso
FROM events""")
def parse_created_at_q(spark, sf_dir):
    """X-style, RFC 2822 (+05:30) and ISO 'Z' texts of events.ts parsed back."""
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts")
    local = ts + F.expr("interval '5' hour") + F.expr("interval '30' minute")
    x_style = ntz_x_style(ts)
    rfc = ntz_rfc(local, "+0530")
    text = ts.cast("string")  # fraction printed without trailing zeros
    frac = F.when(F.instr(text, ".") > 0, F.rpad(F.substring_index(text, ".", -1), 6, "0")).otherwise(
        F.lit("000000"))
    iso = F.concat(ntz_iso(ts), F.lit("."), frac, F.lit("Z"))
    raw = F.when(F.col("event_id") % 3 == 0, x_style).when(F.col("event_id") % 3 == 1, rfc).otherwise(iso)
    return ev.select("event_id", parse_created_at(raw).alias("iso"))


@register("filter_responses", "SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0")
def filter_responses_q(spark, sf_dir):
    """Logged responses of the bookmarks endpoint whose body parses."""
    return X.bookmark_responses(D.response_log(spark, sf_dir)).select("page_id")


# -- the same documents, written as files and read back ------------------------------------


def written_documents(spark, documents) -> str:
    """Writes one multi-line file per document to the scratch folder; returns the folder.

    All in one folder: a reader lists a folder at once, but a folder per document each by a task of its own.
    """
    base = scratch_dir(spark)
    indented = F.replace(F.replace(F.col("value"), F.lit('}, {"'), F.lit('},\n  {\n    "')), F.lit("], "), F.lit("],\n  "))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file costs its opening, however few bytes a task would have
    (documents.repartition(spread, "path").select(indented.alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(base))
    return base


def _without_place(sql: str) -> str:
    return sql.replace("SELECT file_ord, pos, id", "SELECT id")


@register("files_json_export", _without_place(_EXPORT_SQL))
def files_json_export_q(spark, sf_dir):
    """Multi-line export files, found and read as files, format detected per file."""
    got = X.read_captures(spark, written_documents(spark, D.export_documents(spark, sf_dir)))
    return _flat_posts(got).drop("file_ord", "pos")


@register("files_rich", _without_place(_RICH_SQL))
def files_rich_q(spark, sf_dir):
    p = X.read_captures(spark, written_documents(spark, D.rich_documents(spark, sf_dir)))
    return _flat_posts(p, "lang", metric("metrics", "likes").alias("likes"), metric("metrics", "views").alias("views"),
                       metric("metrics", "ratio").alias("ratio"), F.size("metrics").cast("bigint").alias("n_metrics"),
                       F.array_join("hashtags", "|").alias("hashtags")).drop("file_ord", "pos")


@register("files_url_list", _without_place(_URLS_SQL))
def files_url_list_q(spark, sf_dir):
    got = X.read_captures(spark, written_documents(spark, D.url_list_documents(spark, sf_dir)))
    return got.select("id", "url", "source")


# -- the same files, read by several tasks each ---------------------------------------------


@register("large_json_export", _without_place(_EXPORT_SQL))
def large_json_export_q(spark, sf_dir):
    """Export files through the reader for documents larger than a task."""
    got = X.read_captures(spark, written_documents(spark, D.export_documents(spark, sf_dir)), large=1)
    return _flat_posts(got).drop("file_ord", "pos")


@register("large_rich", _without_place(_RICH_SQL))
def large_rich_q(spark, sf_dir):
    p = X.read_captures(spark, written_documents(spark, D.rich_documents(spark, sf_dir)), large=1)
    return _flat_posts(p, "lang", metric("metrics", "likes").alias("likes"), metric("metrics", "views").alias("views"),
                       metric("metrics", "ratio").alias("ratio"), F.size("metrics").cast("bigint").alias("n_metrics"),
                       F.array_join("hashtags", "|").alias("hashtags")).drop("file_ord", "pos")
