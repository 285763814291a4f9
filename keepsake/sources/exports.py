"""Capture exports: JSON export (S4), rich capture (S5), URL list (S6),
format autodetect (S8/S9), enrichment maps (S10), record input (S11).

Every format is a column expression from one parsed document to an
``array<struct>`` of rows, so a mixed set of files is read once: detect the
format per file, pick the matching expression, explode.  Arrival order is
(file_ord, path, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.functions.core import coerce_metrics, default_url, extract_id, strip_ws
from keepsake.functions.variant import (as_array, first_truthy, is_array, is_object, kind, obj, str_list,
                                        str_or, text, truthy, vget)
from keepsake.schema import conform_posts
from keepsake.session import written
from keepsake.sources.files import FILE_ORDER, whole_files
from keepsake.sources.large_json import LARGE, elements, file_list, large_files, large_text

JSON_EXPORT = "json-export"
EXTENSION = "extension"
URL_LIST = "url-list"
# Format names and messages.
UNSUPPORTED_EXPORT = "unsupported export format: expected a list of bookmark objects"
# Python str.splitlines() boundaries.
LINE_BREAKS = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x85\u2028\u2029]"

def _media(v: Column) -> Column:
    """An item's media list as array<struct<thumb,type,url>>; anything but a list is empty."""
    return F.transform(as_array(v), lambda m: F.struct(
        F.try_variant_get(m, "$.thumb", "string").alias("thumb"),
        F.try_variant_get(m, "$.type", "string").alias("type"),
        F.try_variant_get(m, "$.url", "string").alias("url")))


# -- JSON export ------------------------------------------------------------------


def export_items(doc: Column) -> Column:
    """The item list of a document: under ``bookmarks``, else ``data``, of an object
    (the key's presence decides), else the document; a non-list is an error."""
    items = F.when(is_object(doc), F.coalesce(vget(doc, "$.bookmarks"), vget(doc, "$.data"),
                                              F.parse_json(F.lit("[]")))).otherwise(doc)
    return F.when(is_array(items), items).otherwise(F.raise_error(F.lit(UNSUPPORTED_EXPORT)).cast("variant"))


# -- rich capture -----------------------------------------------------------------------


def rich_items(doc: Column) -> Column:
    """The first non-empty of an object's ``bookmarks`` and ``data``, else the document."""
    empty = F.parse_json(F.lit("[]"))
    return F.when(is_object(doc), F.coalesce(first_truthy(vget(doc, "$.bookmarks"), vget(doc, "$.data")), empty)
                  ).otherwise(doc)


def looks_like_rich(items: Column) -> Column:
    """Any item is an object with an object ``author`` or a ``metrics`` key."""
    return F.exists(as_array(items), lambda it: is_object(it) & (
        is_object(vget(it, "$.author")) | vget(it, "$.metrics").isNotNull()))


# -- URL list ---------------------------------------------------------------------------


def url_strings(value: Column, doc: Column) -> Column:
    """URLs of a URL-list document: JSON array items as text, or text lines
    (any Unicode line break) stripped, blanks dropped."""
    from_text = F.filter(F.transform(F.split(value, LINE_BREAKS), lambda s: strip_ws(s)), lambda s: s != "")
    from_json = F.when(is_array(doc), F.transform(as_array(doc), lambda x: text(x))).otherwise(
        F.array().cast("array<string>"))
    return F.when(doc.isNull(), from_text).otherwise(from_json)


# -- autodetect ---------------------------------------------------------------------------


def detect_format(doc: Column) -> Column:
    """Per document: invalid JSON or an all-string list -> url-list; items
    that look rich -> extension; otherwise json-export."""
    all_strings = is_array(doc) & F.forall(as_array(doc), lambda x: kind(x) == "STRING")
    items = F.when(is_object(doc), F.coalesce(vget(doc, "$.bookmarks"), vget(doc, "$.data"),
                                              F.parse_json(F.lit("[]")))).otherwise(doc)
    return (F.when(doc.isNull(), F.lit(URL_LIST))
            .when(all_strings, F.lit(URL_LIST))
            .when(is_array(items) & looks_like_rich(items), F.lit(EXTENSION))
            .otherwise(F.lit(JSON_EXPORT)))


BAD_JSON = "not valid JSON, though it begins like it: "


def _parsed(value: Column) -> Column:
    """The document as VARIANT; null for text that isn't JSON at all (a URL list).

    Text that begins like an object or an array and doesn't parse would be
    split into lines as if it were URLs; that is an error with its path instead.
    """
    doc = F.try_parse_json(value)
    looks = strip_ws(value).rlike(r"^[\[{]")
    return F.when(doc.isNull() & looks, F.raise_error(F.concat(F.lit(BAD_JSON), F.col("path"))).cast("variant")
                  ).otherwise(doc)


def document_items(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """(file_ord, path, format, pos, item) — one row per item of each
    document (an object, a junk value, or a URL string for URL lists)."""
    d = files.withColumn("_doc", F.parse_json(F.col("value")) if fmt == JSON_EXPORT else _parsed(F.col("value")))
    d = d.withColumn("format", F.lit(fmt) if fmt else detect_format(F.col("_doc")))
    doc = F.col("_doc")
    fmt_c = F.col("format")
    urls = url_strings(F.col("value"), doc)
    items = (F.when(fmt_c == URL_LIST, as_array(F.parse_json(F.to_json(urls))))
             .when(fmt_c == EXTENSION, as_array(rich_items(doc)))
             .otherwise(as_array(export_items(doc))))
    return d.select(*FILE_ORDER, "format", F.posexplode(items).alias("pos", "item"))


def posts_from_documents(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """Posts of (file_ord, path, value) documents, each read with its detected
    (or the given) format.  ``pos`` is the item's position in its document.

    Items are exploded first and every field is then a top-level column, so
    shared sub-expressions are computed once per item.
    """
    return posts_from_items(document_items(files, fmt))


def posts_from_items(it: DataFrame) -> DataFrame:
    """Posts of (file_ord, path, format, pos, item) rows."""
    fmt_c = F.col("format")
    is_url = fmt_c == URL_LIST
    is_rich = fmt_c == EXTENSION
    it = it.where(is_url | is_object(F.col("item")))
    item = F.col("item")
    it = (it.withColumn("_url", F.when(is_url, text(item)).otherwise(str_or(vget(item, "$.url"), "")))
          .withColumn("_rid", F.when(~is_url, vget(item, "$.id")))
          .withColumn("_author", F.when(is_rich, obj(vget(item, "$.author")))))
    rid = F.col("_rid")
    ident = F.when(~is_url & truthy(rid), text(rid)).otherwise(extract_id(F.col("_url")))
    it = it.withColumn("id", ident).where(F.col("id") != "")
    url = F.when(is_url | (F.coalesce(F.col("_url"), F.lit("")) != ""), F.col("_url")).otherwise(
        default_url(F.col("id")))
    author = F.col("_author")
    lang = vget(item, "$.lang")
    out = it.select(
        *FILE_ORDER, "pos", "format", "id", url.alias("url"),
        F.when(is_rich, str_or(vget(author, "$.handle"))).when(~is_url, str_or(vget(item, "$.author_handle")))
        .alias("author_handle"),
        F.when(is_rich, str_or(vget(author, "$.name"))).when(~is_url, str_or(vget(item, "$.author_name")))
        .alias("author_name"),
        F.when(~is_url, str_or(vget(item, "$.text"))).alias("text"),
        F.when(is_url, F.lit("")).otherwise(str_or(vget(item, "$.created_at"))).alias("created_at"),
        F.when(is_rich & truthy(lang), text(lang)).alias("lang"),
        F.when(~is_url, _media(vget(item, "$.media"))).alias("media"),
        F.when(is_rich, str_list(vget(item, "$.hashtags"))).alias("hashtags"),
        F.when(is_rich, str_list(vget(item, "$.mentions"))).alias("mentions"),
        F.when(is_rich, str_list(vget(item, "$.links"))).alias("links"),
        F.when(is_rich, coerce_metrics(vget(item, "$.metrics"))).alias("metrics"),
        fmt_c.alias("source"))
    return conform_posts(out, keep=[*FILE_ORDER, "pos", "format"])


def read_captures(spark: SparkSession, paths, fmt: str | None = None, large: int = LARGE) -> DataFrame:
    """Read capture files of any supported format (autodetected per file).

    Files of at least ``large`` bytes are read by several tasks each, with the same result.
    """
    small = posts_from_documents(whole_files(spark, paths, below=large), fmt)
    files = large_files(spark, paths, large)
    return small.unionByName(posts_from_items(large_document_items(spark, paths, files, fmt))) if files else small


# -- documents larger than a task ---------------------------------------------------------


def _numbered(spark: SparkSession, paths, rows: DataFrame, given: bool = False) -> DataFrame:
    """``rows`` with the ``file_ord`` of their path: the column ``given`` if that is known."""
    if given:
        return rows.withColumnRenamed("given", "file_ord")
    return rows.join(file_list(spark, paths).select("file_ord", "path"), "path")


def large_document_items(spark: SparkSession, paths, files: tuple[list[str], int], fmt: str | None = None) -> DataFrame:
    """As :func:`document_items` for large files, of which no task holds more than a split."""
    rows = written(elements(spark, *files))
    items = rows.where("pos is not null").withColumn("item", F.parse_json("text"))
    item = F.col("item")
    facts = items.groupBy("path", "member").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(kind(item) == "STRING").alias("strings"),
        F.bool_or(F.coalesce(is_object(item) & (is_object(vget(item, "$.author")) | vget(item, "$.metrics").isNotNull()),
                             F.lit(False))).alias("rich"))
    heads = rows.where("pos is null and name in ('bookmarks', 'data')").join(facts, ["path", "member"], "left")
    last = heads.groupBy("path", "name").agg(F.max_by(F.struct("member", "text", "n", "rich"), "member").alias("h"))
    named = last.groupBy("path").agg(*[F.max(F.when(F.col("name") == n, F.col("h"))).alias(n) for n in ("bookmarks", "data")])
    lists = items.where("name is null").select("path").distinct().join(facts, "path").where("member = 0").select(
        "path", F.col("strings").alias("all_strings"), F.col("rich").alias("list_rich"), F.lit(True).alias("is_list"))
    docs = rows.select("path").distinct().join(named, "path", "left").join(lists, "path", "left")
    present = F.coalesce("bookmarks", "data")  # the key's presence decides
    full = [F.when((F.col(f"{c}.n") > 0) | (F.col(f"{c}.text").isNotNull() & truthy(F.parse_json(F.col(f"{c}.text")))),
                   F.col(c)) for c in ("bookmarks", "data")]
    found = (F.lit(fmt) if fmt else F.when(F.coalesce("all_strings", F.lit(False)), F.lit(URL_LIST))
             .when(F.coalesce("list_rich", F.col("present.rich"), F.lit(False)), F.lit(EXTENSION)).otherwise(F.lit(JSON_EXPORT)))
    docs = docs.withColumns({"present": present, "full": F.coalesce(*full)}).withColumn("format", found)
    no_list = (F.col("format") == JSON_EXPORT) & F.col("present").isNotNull() & F.col("present.text").isNotNull()
    docs = written(docs.withColumn("no_list", no_list))
    odd = docs.where("no_list").select("path").first()  # docs has a row per large file
    if odd is not None:
        raise ValueError(f"{UNSUPPORTED_EXPORT}: {odd.path}")
    member = (F.when(F.coalesce("is_list", F.lit(False)), F.lit(0).cast("bigint"))
              .when(F.col("format") == EXTENSION, F.col("full.member"))
              .when(F.col("format") == JSON_EXPORT, F.col("present.member")))
    chosen = docs.select("path", "format", member.alias("member"))
    texts = _large_url_lists(spark, files, fmt) if fmt in (None, URL_LIST) else None
    found_items = chosen.join(items.select("path", "member", F.col("pos").cast("int").alias("pos"), "item"), ["path", "member"])
    out = found_items.select("path", "format", "pos", "item")
    out = out.unionByName(texts) if texts is not None else out
    return _numbered(spark, paths, out).select(*FILE_ORDER, "format", "pos", "item")


def _large_url_lists(spark: SparkSession, files: tuple[list[str], int], fmt: str | None) -> DataFrame:
    """The URLs of large text files: those whose first line doesn't begin like a JSON document.

    Positions number the URLs of a file; they come from a running count over its splits.
    """
    raw = large_text(spark, files[0], "\n", files[1]).select(
        "path", "block", F.monotonically_increasing_id().alias("line"), "value")
    urls = raw.select("path", "block", "line", F.posexplode(F.split("value", LINE_BREAKS)).alias("part", "url")).select(
        "path", "block", "line", "part", strip_ws(F.col("url")).alias("url")).where("url <> ''")
    begin = urls.where("block = 0").groupBy("path").agg(F.min_by("url", F.struct("line", "part")).alias("begin"))
    plain = begin.where(~F.col("begin").rlike(r"^\ufeff?[\[{]")).select("path")
    kept = written(urls.join(F.broadcast(plain), "path"))  # one row per large file
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("path", "block").orderBy("line", "part")  # one split
    numbered = kept.withColumn("k", F.row_number().over(own)).join(F.broadcast(sizes), ["path", "block"])
    return numbered.select("path", F.lit(URL_LIST).alias("format"), (F.col("base") + F.col("k") - 1).cast("int").alias("pos"),
                           F.parse_json(F.to_json(F.struct("url"))).alias("item")).withColumn(
        "item", vget(F.col("item"), "$.url"))


# -- enrichment maps ----------------------------------------------------------------------------

MAP_ORDER = ("file_ord", "path", "pos")


def _entry_columns(ex: DataFrame) -> DataFrame:
    """Mapping rows of (file_ord, path, pos, id, e)."""
    e = F.col("e")
    tags_v = vget(e, "$.tags")
    tags = F.when(is_array(tags_v), str_list(tags_v)).otherwise(F.array().cast("array<string>"))
    return ex.select("file_ord", "path", "pos", "id", str_or(vget(e, "$.summary")).alias("summary"),
                     str_or(vget(e, "$.topic")).alias("topic"), tags.alias("tags"))


def mapping_entries(files: DataFrame) -> DataFrame:
    """(file_ord, path, pos, id, summary, topic, tags) of enrichment files:
    an object keyed by id (non-object values ignored) or a list of objects
    with a truthy ``id``.  Later entries/files win (see :func:`load_mapping`)."""
    doc = F.parse_json(F.col("value"))
    as_map = F.coalesce(F.when(is_object(doc), F.try_variant_get(doc, "$", "map<string,variant>")),
                        F.create_map().cast("map<string,variant>"))
    from_map = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("e")))
    from_list = F.transform(F.filter(as_array(doc), lambda e: is_object(e) & truthy(vget(e, "$.id"))),
                            lambda e: F.struct(text(vget(e, "$.id")).alias("id"), e.alias("e")))
    entries = F.filter(F.when(is_object(doc), from_map).otherwise(from_list), lambda x: is_object(x["e"]))
    ex = files.select("file_ord", "path", F.posexplode(entries).alias("pos", "x"))
    return _entry_columns(ex.select("file_ord", "path", "pos", F.col("x.id").alias("id"), F.col("x.e").alias("e")))


def large_mapping_entries(spark: SparkSession, paths, files: tuple[list[str], int]) -> DataFrame:
    """As :func:`mapping_entries` for large files: members of an object, or elements of a list."""
    rows = elements(spark, *files, inner=False).where("text is not null").withColumn("e", F.parse_json("text"))
    e, listed = F.col("e"), F.col("name").isNull()
    rows = rows.where(is_object(e) & (~listed | truthy(vget(e, "$.id")))).select(
        "path", "given", F.when(listed, F.col("pos")).otherwise(F.col("member")).alias("pos"),
        F.when(listed, text(vget(e, "$.id"))).otherwise(F.col("name")).alias("id"), "e")
    found = _numbered(spark, paths, rows, given=files[1] > 0)
    return _entry_columns(found).withColumn("pos", F.col("pos").cast("int"))


def load_mapping(spark: SparkSession, paths, large: int = LARGE) -> DataFrame:
    """(id, summary, topic, tags), last entry per id winning."""
    from keepsake.operators.merge import dedupe_last
    ent = mapping_entries(whole_files(spark, paths, below=large))
    files = large_files(spark, paths, large)
    if files:
        ent = ent.unionByName(large_mapping_entries(spark, paths, files))
    return dedupe_last(ent, "id", list(MAP_ORDER)).drop(*MAP_ORDER)


# -- record input ----------------------------------------------------------------------------

NOT_OBJECT = "each record must be a JSON object"


def read_records(spark: SparkSession, paths, large: int = LARGE) -> DataFrame:
    """(file_ord, path, pos, value): each record of the input files as JSON text.

    A large file holds a list, of which each element is read alone.
    """
    items = whole_files(spark, paths, below=large).select(
        "file_ord", "path", F.posexplode(record_items(F.col("value"))).alias("pos", "v"))
    out = items.select("file_ord", "path", F.col("pos").cast("bigint").alias("pos"), F.to_json("v").alias("value"))
    files = large_files(spark, paths, large)
    if files:
        v = F.col("v")
        rows = elements(spark, *files).withColumn("v", F.parse_json("text"))
        checked = F.when((F.col("pos").isNotNull()) & F.col("name").isNull() & is_object(v), v).otherwise(
            F.raise_error(F.lit(NOT_OBJECT)).cast("variant"))
        rows = _numbered(spark, paths, rows.select("path", F.col("pos").cast("bigint").alias("pos"),
                                                   F.to_json(checked).alias("value")))
        out = out.unionByName(rows)
    return out


def record_items(value: Column) -> Column:
    """One object or an array of objects; any non-object rejects the batch."""
    doc = F.parse_json(value)
    items = F.when(is_array(doc), as_array(doc)).otherwise(F.array(doc))
    return F.transform(items, lambda x: F.when(is_object(x), x).otherwise(
        F.raise_error(F.lit(NOT_OBJECT)).cast("variant")))


# -- captured responses --------------------------------------------------------------------------

BOOKMARKS_URL_PATTERN = r"(?U)/graphql/[^/]+/Bookmarks\b"


def bookmark_responses(log: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Keep logged responses of the bookmarks endpoint whose body parses."""
    return log.where(F.col(url).rlike(BOOKMARKS_URL_PATTERN) & F.try_parse_json(F.col(body)).isNotNull())


__all__ = ["url_strings", "document_items", "posts_from_items", "large_document_items", "read_records", "detect_format", "looks_like_rich",
           "posts_from_documents", "read_captures", "mapping_entries", "load_mapping", "record_items",
           "bookmark_responses"]
