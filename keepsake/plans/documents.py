"""Capture documents derived from the driver tables (FIXTURES.md §3).

Each document packs the posts of 20 consecutive doc_ids (a bounded group,
so ``collect_list`` never gathers an unbounded group) into one JSON text in
one of the capture shapes.  The parsers in ``keepsake.sources`` read them
back; the oracle SQL derives the expected rows straight from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.plans.tables import table

GROUP = 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("g", (F.col("doc_id") / GROUP).cast("bigint"))


def _iso(minutes: str = "doc_id") -> Column:
    from keepsake.functions.core import ntz_iso
    return ntz_iso(F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + {minutes} * interval '1' minute"))


def status_url() -> Column:
    d = F.col("doc_id")
    return F.when(d % 13 == 0, F.lit("javascript:x")).otherwise(
        F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/"), d.cast("string")))


def _pack(df: DataFrame, item_json: Column, prefix: str) -> DataFrame:
    """One row per group: (g, items JSON texts in doc_id order)."""
    grouped = df.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("doc_id", item_json.alias("j")))).alias("xs"))
    return grouped.select("g", F.array_join(F.transform("xs", lambda x: x["j"]), ", ").alias("items"),
                          F.concat(F.lit(prefix), F.col("g").cast("string")).alias("path"))


def _files(df: DataFrame, value: Column, ord_base: int) -> DataFrame:
    return df.select((F.col("g") + F.lit(ord_base)).alias("file_ord"), "path", value.alias("value"))


def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat JSON exports in three envelopes with junk items; doc_id % 7 = 0
    has no id (taken from the URL), doc_id % 9 = 0 no URL (default URL),
    doc_id % 4 = 0 one photo."""
    d = _docs(spark, sf_dir)
    media = F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(
        F.lit("photo").alias("type"),
        F.concat(F.lit("https://media.example/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("url")))
    ).otherwise(F.array().cast("array<struct<type:string,url:string>>"))
    item = F.to_json(F.struct(
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("id"),
        F.when(F.col("doc_id") % 9 != 0, status_url()).alias("url"), F.col("source").alias("author_handle"),
        F.upper("source").alias("author_name"), F.col("text"), _iso().alias("created_at"), media.alias("media")))
    p = _pack(d, item, "export/")
    g3 = F.col("g") % 3
    value = (F.when(g3 == 0, F.concat(F.lit('{"bookmarks": ['), F.col("items"), F.lit("]}")))
             .when(g3 == 1, F.concat(F.lit('{"data": ['), F.col("items"), F.lit(', 42, "junk"]}')))
             .otherwise(F.concat(F.lit("["), F.col("items"), F.lit(', "junk", null]'))))
    return _files(p, value, 0)


def rich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich captures: nested author, tampered metrics (a string count, an HTML
    string, a float), JSON-null created_at for doc_id % 6 = 0."""
    d = _docs(spark, sf_dir)
    metrics = F.parse_json(F.concat(
        F.lit('{"likes": '), (F.col("n_chars") % 1000).cast("string"),
        F.lit(', "views": "'), F.col("n_chars").cast("string"),
        F.lit('", "bad": "<b>x</b>", "ratio": 2.5}')))
    item = F.to_json(F.struct(
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("id"),
        status_url().alias("url"), F.col("text"),
        F.when(F.col("doc_id") % 6 != 0, _iso()).alias("created_at"),
        F.col("lang"),
        F.struct(F.col("source").alias("handle"), F.upper("source").alias("name"), F.lit("a").alias("avatar"))
        .alias("author"),
        metrics.alias("metrics"), F.array("lang").alias("hashtags"), F.array().cast("array<string>").alias("links"),
        F.lit(False).alias("is_quote")), {"ignoreNullFields": "false"})
    p = _pack(d, item, "rich/")
    value = F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"bookmarks": ['), F.col("items"), F.lit("]}"))).otherwise(
        F.concat(F.lit("["), F.col("items"), F.lit("]")))
    return _files(p, value, 1 << 20)


def url_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL lists: padded text lines with mixed line breaks (CRLF, U+2028,
    blank lines) for even groups, a JSON array of strings for odd ones."""
    d = _docs(spark, sf_dir)
    url = F.when(F.col("doc_id") % 13 == 0, F.lit("https://example.com/nothing")).otherwise(
        F.concat(F.lit("https://x.com/"), F.col("source"), F.lit("/status/"), F.col("doc_id").cast("string")))
    sep = (F.when(F.col("doc_id") % 5 == 0, F.lit("\r\n")).when(F.col("doc_id") % 11 == 0, F.lit("\u2028"))
           .otherwise(F.lit("\n\n")))
    as_line = F.concat(F.lit("  "), url, F.lit(" "), sep)
    grouped = d.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(
        "doc_id", as_line.alias("line"), url.alias("url")))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["line"]), "")
    js = F.to_json(F.transform("xs", lambda x: x["url"]))
    value = F.when(F.col("g") % 2 == 0, text).otherwise(js)
    out = grouped.select("g", F.concat(F.lit("urls/"), F.col("g").cast("string")).alias("path"), value.alias("value"))
    return _files(out, F.col("value"), 2 << 20)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three capture shapes together (for autodetect and union)."""
    return (export_documents(spark, sf_dir).unionByName(rich_documents(spark, sf_dir))
            .unionByName(url_list_documents(spark, sf_dir)))


# -- raw payloads ------------------------------------------------------------------------


def _x_created(d: Column) -> Column:
    """X-style text; doc_id % 3 = 1 uses RFC 2822 with a +02:00 offset."""
    from keepsake.functions.core import ntz_rfc, ntz_x_style
    base = F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '1' minute")
    local = base + F.expr("interval '2' hour")
    return F.when(d % 3 == 1, ntz_rfc(local, "+0200")).otherwise(ntz_x_style(base))


_MEDIA_T = ("array<struct<type:string,media_url_https:string,"
            "video_info:struct<variants:array<struct<content_type:string,bitrate:int,url:string>>>>>")


def tweet_result(text_col: Column) -> Column:
    """A raw result object (as a struct) for the current document row."""
    d = F.col("doc_id")
    src = F.col("source")
    img = F.concat(F.lit("https://img.example/"), d.cast("string"))
    video = F.struct(
        F.lit("video").alias("type"), F.concat(img, F.lit(".jpg")).alias("media_url_https"),
        F.struct(F.array(
            F.struct(F.lit("video/mp4").alias("content_type"), F.lit(832000).alias("bitrate"),
                     F.concat(img, F.lit("/low.mp4")).alias("url")),
            F.struct(F.lit("application/x-mpegURL").alias("content_type"), F.lit(None).cast("int").alias("bitrate"),
                     F.concat(img, F.lit("/pl.m3u8")).alias("url")),
            F.struct(F.lit("video/mp4").alias("content_type"), F.lit(2176000).alias("bitrate"),
                     F.concat(img, F.lit("/high.mp4")).alias("url"))).alias("variants")).alias("video_info"))
    photo = F.struct(F.lit("photo").alias("type"), F.concat(img, F.lit(".jpg")).alias("media_url_https"),
                     F.lit(None).cast("struct<variants:array<struct<content_type:string,bitrate:int,url:string>>>")
                     .alias("video_info"))
    media = (F.when(d % 4 == 0, F.array(video)).when(d % 3 == 0, F.array(photo))
             .otherwise(F.array().cast(_MEDIA_T)))
    legacy = F.struct(
        text_col.alias("full_text"), _x_created(d).alias("created_at"), F.col("lang"),
        (F.col("n_chars") % 1000).alias("favorite_count"), (d % 5).alias("retweet_count"),
        (d % 2 == 0).alias("is_quote_status"),
        F.struct(F.array(F.struct(F.col("lang").alias("text"))).alias("hashtags"),
                 F.array(F.struct(src.alias("screen_name"))).alias("user_mentions"),
                 F.array(F.struct(F.concat(F.lit("https://t.co/"), d.cast("string")).alias("url"),
                                  F.concat(F.lit("https://www.Example.com/a/"), d.cast("string")).alias("expanded_url")))
                 .alias("urls")).alias("entities"),
        F.struct(media.alias("media")).alias("extended_entities"))
    user = F.struct(F.struct(F.struct(F.struct(src.alias("screen_name"), F.upper(src).alias("name"),
                                               F.concat(F.lit("https://img.example/u/"), src)
                                               .alias("profile_image_url_https")).alias("legacy")).alias("result"))
                    .alias("user_results"))
    note = F.when(d % 7 == 0, F.struct(F.struct(F.struct(F.concat(F.lit("NOTE "), text_col).alias("text"))
                                                .alias("result")).alias("note_tweet_results")))
    base = F.struct(F.lit("Tweet").alias("__typename"), d.cast("string").alias("rest_id"), user.alias("core"),
                    legacy.alias("legacy"), note.alias("note_tweet"),
                    F.struct(F.col("n_chars").cast("string").alias("count")).alias("views"))
    return base


def _result_json(text_col: Column) -> Column:
    base = F.to_json(tweet_result(text_col))
    wrapped = F.concat(F.lit('{"__typename": "TweetWithVisibilityResults", "tweet": '), base, F.lit("}"))
    return F.when(F.col("doc_id") % 5 == 0, wrapped).otherwise(base)


def _entry(result_json: Column) -> Column:
    return F.concat(F.lit('{"entryId": "tweet-'), F.col("doc_id").cast("string"),
                    F.lit('", "content": {"itemContent": {"tweet_results": {"result": '), result_json,
                    F.lit("}}}}"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, path, value): one raw timeline page per 20 documents, the
    first post repeated at the end with other text (first must win)."""
    d = _docs(spark, sf_dir)
    first_dup = _entry(_result_json(F.lit("DUP")))
    grouped = d.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(
        "doc_id", _entry(_result_json(F.col("text"))).alias("e"), first_dup.alias("dup")))).alias("xs"))
    entries = F.concat(F.array_join(F.transform("xs", lambda x: x["e"]), ", "), F.lit(", "),
                       F.get(F.col("xs"), 0)["dup"])
    value = F.concat(F.lit('{"data": {"bookmark_timeline_v2": {"timeline": {"instructions": ['
                           '{"type": "TimelineAddEntries", "entries": ['), entries, F.lit("]}]}}}}"))
    out = grouped.select(F.col("g").alias("file_ord"), F.concat(F.lit("payload/"), F.col("g").cast("string"))
                         .alias("path"), value.alias("value"))
    return out


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, body): pages.url with the bookmarks endpoint appended
    for even page_id; bodies of page_id % 3 = 0 are not JSON."""
    pg = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.col("url"), F.lit("/graphql/q/Bookmarks"))).otherwise(
        F.col("url"))
    body = F.when(F.col("page_id") % 3 == 0, F.lit("<html>not json")).otherwise(
        F.to_json(F.struct(F.col("page_id"))))
    return pg.select("page_id", url.alias("url"), body.alias("body"))
