"""Normalisation of raw post objects to capture records.

A raw result is parsed once with ``from_json`` against a typed schema that
names only the fields the normaliser reads (everything else is skipped by
the parser); the rest is struct-field access and string rules, which keeps
the generated code small enough for whole-stage code generation.

Scalar leaves are read as text (a JSON number arrives as its text), and the
Python truthiness of ``x or y`` is applied to that text: '' and NULL are
falsy, and for counts and flags also "0"/"false".  Documented deviation: a
string "12.7" view count cannot be told apart from the number 12.7 (taken as 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.core import DEFAULT_URL_PREFIX, falsy_coalesce, nonblank, parse_created_at
from keepsake.operators.merge import dedupe_first
from keepsake.schema import CAPTURE_SCHEMA, conform_posts

WRAPPER_TYPE = "TweetWithVisibilityResults"
CAPTURE_SOURCE = "x-bookmarks"
VIDEO_MP4 = "video/mp4"
CAPTURE_FIELDS = [f.name for f in CAPTURE_SCHEMA.fields]

S = T.StringType()


def _st(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_VARIANTS = T.ArrayType(_st(content_type=S, bitrate=S, url=S))
_MEDIA = T.ArrayType(_st(type=S, media_url_https=S, video_info=_st(variants=_VARIANTS)))
_ENTITIES = _st(hashtags=T.ArrayType(_st(text=S)), user_mentions=T.ArrayType(_st(screen_name=S)),
                urls=T.ArrayType(_st(url=S, expanded_url=S)), media=_MEDIA)
_NAMES = _st(screen_name=S, name=S, profile_image_url_https=S)
_TWEET_FIELDS = dict(
    rest_id=S,
    core=_st(user_results=_st(result=_st(legacy=_NAMES, core=_st(screen_name=S, name=S),
                                         avatar=_st(image_url=S)))),
    legacy=_st(id_str=S, full_text=S, text=S, created_at=S, lang=S, favorite_count=S, retweet_count=S,
               reply_count=S, quote_count=S, bookmark_count=S, is_quote_status=S, entities=_ENTITIES,
               extended_entities=_st(media=_MEDIA)),
    note_tweet=_st(note_tweet_results=_st(result=_st(text=S, entity_set=_ENTITIES))),
    views=_st(count=S),
)
TWEET_SCHEMA = _st(**_TWEET_FIELDS)
RESULT_SCHEMA = _st(__typename=S, tweet=TWEET_SCHEMA, **_TWEET_FIELDS)


def _nz(c: Column) -> Column:
    """Truthy text of a scalar leaf (NULL, '', and JSON null/false/0 are falsy)."""
    return F.when(~F.coalesce(c, F.lit("")).isin("", "0", "false", "null"), c)


def _count(c: Column) -> Column:
    """``value or 0`` of a count, as bigint."""
    return F.coalesce((_nz(c)).try_cast("bigint"), F.lit(0).cast("bigint"))


def best_variant_url(m: Column) -> Column:
    """Highest-bitrate mp4 URL (missing bitrate = 0, first wins ties), else
    the still-image URL, else ''."""
    variants = F.coalesce(m["video_info"]["variants"], F.array().cast(_VARIANTS))
    indexed = F.transform(variants, lambda v, i: F.struct(
        (-F.coalesce((v["bitrate"]).try_cast("double"), F.lit(0.0))).alias("neg"), i.alias("idx"),
        v["content_type"].alias("ct"), v["url"].alias("url")))
    mp4 = F.array_sort(F.filter(indexed, lambda x: F.coalesce(x["ct"] == VIDEO_MP4, F.lit(False))))
    top = F.get(mp4, 0)["url"]
    return F.when(F.coalesce(top, F.lit("")) != "", top).otherwise(F.coalesce(m["media_url_https"], F.lit("")))


def _texts(arr: Column, key: str, elem: T.DataType) -> Column:
    vals = F.transform(F.coalesce(arr, F.array().cast(elem)), lambda h: h[key])
    return F.filter(vals, lambda x: F.coalesce(x, F.lit("")) != "")


def normalize_results(df: DataFrame, result: str = "result", captured_at: str = "") -> DataFrame:
    """Add the CAPTURE_SCHEMA columns for a column of raw result JSON texts
    (other input columns are kept); rows without an id get a NULL ``id``."""
    keep = [c for c in df.columns if c not in CAPTURE_FIELDS and c != result]
    # The parse is produced by a one-row generator: filters on derived columns
    # (e.g. the id) are then not pushed below it, so it is never re-inlined
    # and the document is parsed once per row.
    parsed = F.struct(F.from_json(F.col(result), RESULT_SCHEMA, {"mode": "PERMISSIVE"}).alias("_r"))
    p = df.select(*keep, F.inline(F.array(parsed)))
    r = F.col("_r")
    top = F.struct(*[r[k].alias(k) for k in _TWEET_FIELDS])
    wrapped = F.coalesce((r["__typename"] == WRAPPER_TYPE) & r["tweet"].isNotNull(), F.lit(False))
    p = p.select(*keep, F.when(r.isNotNull(), F.when(wrapped, r["tweet"]).otherwise(top)).alias("_t"))
    t = F.col("_t")
    legacy = t["legacy"]
    user = t["core"]["user_results"]["result"]
    note = t["note_tweet"]["note_tweet_results"]["result"]
    ne = note["entity_set"]

    def n(a):
        return F.coalesce(F.size(a), F.lit(0))

    has_note_ents = (n(ne["hashtags"]) + n(ne["user_mentions"]) + n(ne["urls"]) + n(ne["media"])) > 0
    ents = F.when(has_note_ents, ne).otherwise(legacy["entities"])
    ext_media = legacy["extended_entities"]["media"]
    media_list = F.when(n(ext_media) > 0, ext_media).otherwise(legacy["entities"]["media"])
    ident = F.coalesce(nonblank(t["rest_id"]), nonblank(legacy["id_str"]))
    handle = falsy_coalesce(user["core"]["screen_name"], user["legacy"]["screen_name"])
    p = p.select(*keep, "_t", ident.alias("id"), handle.alias("_handle"), ents.alias("_ents"),
                 media_list.alias("_media"))
    e = F.col("_ents")
    urls = F.transform(F.coalesce(e["urls"], F.array().cast(_ENTITIES["urls"].dataType)),
                       lambda u: F.coalesce(nonblank(u["expanded_url"]), nonblank(u["url"])))
    media = F.transform(F.coalesce(F.col("_media"), F.array().cast(_MEDIA)), lambda m: F.struct(
        m["media_url_https"].alias("thumb"), m["type"].alias("type"),
        F.when(m["type"] == "photo", m["media_url_https"]).otherwise(best_variant_url(m)).alias("url")))
    view_count = F.coalesce((F.trim(t["views"]["count"])).try_cast("bigint"), F.lit(0).cast("bigint"))
    metrics = F.create_map(F.lit("likes"), _count(legacy["favorite_count"]),
                           F.lit("retweets"), _count(legacy["retweet_count"]),
                           F.lit("replies"), _count(legacy["reply_count"]),
                           F.lit("quotes"), _count(legacy["quote_count"]),
                           F.lit("bookmarks"), _count(legacy["bookmark_count"]),
                           F.lit("views"), view_count)
    h = F.col("_handle")
    idc = F.col("id")
    url = F.when(h != "", F.concat(F.lit(DEFAULT_URL_PREFIX), h, F.lit("/status/"), idc)).otherwise(
        F.concat(F.lit(DEFAULT_URL_PREFIX + "i/status/"), idc))
    cols = {
        "id": idc,
        "url": url,
        "text": falsy_coalesce(note["text"], legacy["full_text"], legacy["text"]),
        "lang": nonblank(legacy["lang"]),
        "created_at": parse_created_at(legacy["created_at"]),
        "author": F.struct(falsy_coalesce(user["core"]["name"], user["legacy"]["name"]).alias("name"),
                           h.alias("handle"),
                           falsy_coalesce(user["avatar"]["image_url"], user["legacy"]["profile_image_url_https"])
                           .alias("avatar")),
        "media": media,
        "metrics": metrics,
        "hashtags": _texts(e["hashtags"], "text", _ENTITIES["hashtags"].dataType),
        "mentions": _texts(e["user_mentions"], "screen_name", _ENTITIES["user_mentions"].dataType),
        "links": F.filter(urls, lambda x: x.isNotNull()),
        "is_quote": _nz(legacy["is_quote_status"]).isNotNull(),
        "captured_at": F.lit(captured_at),
        "source": F.lit(CAPTURE_SOURCE),
    }
    ok = t.isNotNull()
    return p.select(*keep, *[F.when(ok, c).cast(CAPTURE_SCHEMA[k].dataType).alias(k) for k, c in cols.items()])


def normalize_payloads(results: DataFrame, order: Sequence[str], captured_at: str = "") -> DataFrame:
    """Capture records of extracted results, one per id, first occurrence
    (by ``order``) winning.  Keeps the order columns."""
    caps = normalize_results(results.select(*order, "result"), "result", captured_at)
    caps = caps.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return dedupe_first(caps, "id", list(order))


def capture_to_posts(captures: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Capture records as posts (what ingesting a rich capture file gives):
    nested author flattened, metrics kept, source rewritten to 'extension'."""
    df = captures.select(
        *keep, "id", "url", F.col("author.handle").alias("author_handle"), F.col("author.name").alias("author_name"),
        "text", "created_at", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "media", "hashtags",
        "mentions", "links", "metrics", F.lit("extension").alias("source"))
    return conform_posts(df, keep=list(keep))


def export_capture(captures: DataFrame, order: Sequence[str]) -> DataFrame:
    """Captures sorted for export: created_at descending (NULL as ''), ties in
    first-seen ``order``."""
    return captures.orderBy(F.coalesce(F.col("created_at"), F.lit("")).desc(), *[F.col(c) for c in order])


def write_capture(captures: DataFrame, order: Sequence[str], path: str) -> None:
    """Write captures as JSON lines in export order: files ascend in it, and so do the lines of each.

    The rich-capture reader takes such a folder's lines as items.
    """
    newest = F.coalesce(F.col("created_at"), F.lit("")).desc()
    ranged = captures.repartitionByRange(newest, *[F.col(c) for c in order])
    (ranged.sortWithinPartitions(newest, *[F.col(c) for c in order]).drop(*order)
     .select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path))
