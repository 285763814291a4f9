"""JSON-shaped row functions: model prompts/responses and fetched content.

All of these are expressions over VARIANT (``try_parse_json`` +
``variant_get``), so malformed input becomes a NULL/error value on that row
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.core import strip_ws

INVALID_RESPONSE = "invalid response: not a JSON object"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _get(v: Column, path: str, default: str = "") -> Column:
    """``str(obj.get(key, default))`` for scalar values; missing -> default."""
    raw = F.try_variant_get(v, path, "variant")
    as_text = F.try_variant_get(v, path, "string")
    return (F.when(raw.isNull(), F.lit(default))
            .when(F.is_variant_null(raw), F.lit("None"))
            .otherwise(F.coalesce(as_text, F.to_json(raw))))


def build_prompt(handle="author_handle", name="author_name", url="url", text="text") -> Column:
    """'Author: @h (name)' (only with a handle), 'URL: ...', 'Text: ...' lines."""
    h = F.coalesce(_c(handle), F.lit(""))
    author = F.when(h != "", strip_ws(F.concat(F.lit("Author: @"), h, F.lit(" ("),
                                               F.coalesce(_c(name), F.lit("")), F.lit(")"))))
    return F.concat_ws("\n", author,
                       F.concat(F.lit("URL: "), F.coalesce(_c(url), F.lit(""))),
                       F.concat(F.lit("Text: "), F.coalesce(_c(text), F.lit(""))))


def unfence(text) -> Column:
    """Trim; when it starts with a code fence, strip backticks and cut to the
    first '{' (if any)."""
    t = strip_ws(F.coalesce(_c(text), F.lit("")))
    bare = F.regexp_replace(t, r"^`+|`+$", "")
    pos = F.instr(bare, "{")
    cut = F.when(pos > 0, F.concat(F.lit("{"), F.substr(bare, pos + 1))).otherwise(bare)
    return F.when(t.startswith("```"), cut).otherwise(t)


def _clean_tags(v: Column) -> Column:
    tags = F.try_variant_get(v, "$.tags", "array<variant>")
    as_text = F.transform(F.coalesce(tags, F.array().cast("array<variant>")),
                          lambda x: F.lower(strip_ws(F.coalesce(F.try_variant_get(x, "$", "string"),
                                                                F.to_json(x)))))
    return F.filter(as_text, lambda t: t != "")


def parse_response(text) -> Column:
    """Model response -> struct(summary, topic, tags, error).

    Tolerates a code fence; tags must be a list (anything else = no tags),
    each trimmed and lower-cased, blanks dropped; summary/topic trimmed.
    Unparseable or non-object JSON sets ``error`` and leaves the rest NULL.
    """
    v = F.try_parse_json(unfence(text))
    ok = v.isNotNull() & is_object(v)
    return F.struct(
        F.when(ok, strip_ws(_get(v, "$.summary"))).alias("summary"),
        F.when(ok, strip_ws(_get(v, "$.topic"))).alias("topic"),
        F.when(ok, _clean_tags(v)).alias("tags"),
        F.when(~ok, F.lit(INVALID_RESPONSE)).alias("error"),
    )


def parse_content(raw) -> Column:
    """Fetched-content JSON -> struct(text, author_handle, author_name,
    created_at, media array<struct<type,url>>, found).  An empty or
    non-object document is not found."""
    v = F.try_parse_json(_c(raw))
    found = v.isNotNull() & is_object(v) & (F.to_json(v) != "{}")
    user = F.try_variant_get(v, "$.user", "variant")
    user = F.when(is_object(user), user)
    media = F.coalesce(F.try_variant_get(v, "$.mediaDetails", "array<variant>"), F.array().cast("array<variant>"))
    media_t = F.transform(media, lambda m: F.struct(
        F.coalesce(F.try_variant_get(m, "$.type", "string"), F.lit("")).alias("type"),
        F.coalesce(F.try_variant_get(m, "$.media_url_https", "string"), F.lit("")).alias("url")))
    return F.struct(
        F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")).alias("text"),
        F.coalesce(F.try_variant_get(user, "$.screen_name", "string"), F.lit("")).alias("author_handle"),
        F.coalesce(F.try_variant_get(user, "$.name", "string"), F.lit("")).alias("author_name"),
        F.coalesce(F.try_variant_get(v, "$.created_at", "string"), F.lit("")).alias("created_at"),
        media_t.alias("media"),
        found.alias("found"),
    )
