"""Typed schemas for posts, captures and generic records.

POST_SCHEMA declares its fields alphabetically so that ``to_json(struct(*))``
emits keys in sorted order, which makes snapshot lines deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA_TYPE = T.ArrayType(T.StructType([
    T.StructField("thumb", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
]))
STR_ARRAY = T.ArrayType(T.StringType())
METRICS_TYPE = T.MapType(T.StringType(), T.LongType())

POST_SCHEMA = T.StructType([
    T.StructField("author_handle", T.StringType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("enrich_error", T.StringType()),
    T.StructField("enriched", T.BooleanType()),
    T.StructField("enriched_at", T.StringType()),
    T.StructField("hashtags", STR_ARRAY),
    T.StructField("id", T.StringType(), False),
    T.StructField("imported_at", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("links", STR_ARRAY),
    T.StructField("media", MEDIA_TYPE),
    T.StructField("mentions", STR_ARRAY),
    T.StructField("metrics", METRICS_TYPE),
    T.StructField("source", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("tags", STR_ARRAY),
    T.StructField("tags_source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("thread_ids", STR_ARRAY),
    T.StructField("topic", T.StringType()),
    T.StructField("url", T.StringType(), False),
])
POST_FIELDS = [f.name for f in POST_SCHEMA.fields]

# Normalised capture record (raw payload -> one row per post).
CAPTURE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("author", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("avatar", T.StringType()),
    ])),
    T.StructField("media", MEDIA_TYPE),
    T.StructField("metrics", METRICS_TYPE),
    T.StructField("hashtags", STR_ARRAY),
    T.StructField("mentions", STR_ARRAY),
    T.StructField("links", STR_ARRAY),
    T.StructField("is_quote", T.BooleanType()),
    T.StructField("captured_at", T.StringType()),
    T.StructField("source", T.StringType()),
])


def _default(field: T.StructField) -> Column:
    t = field.dataType
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    if isinstance(t, T.MapType):
        return F.create_map().cast(t)
    raise TypeError(t)


# Fields that keep NULL instead of the default (an explicit JSON null passes
# through the rich-capture path for created_at).
_NULLABLE = {"created_at"}


def conform_posts(df: DataFrame, keep=()) -> DataFrame:
    """Known-fields projection with defaults; unknown columns are ignored
    (except those named in ``keep``, which lead the result).

    A missing ``id``/``url`` is an error, as in the original model.
    """
    present = set(df.columns)
    cols = []
    for f in POST_SCHEMA.fields:
        if f.name in ("id", "url"):
            if f.name not in present:
                raise ValueError(f"posts need a {f.name!r} column")
            c = F.col(f.name).cast("string")
            c = F.when(c.isNull(), F.raise_error(F.lit(f"post is missing {f.name}"))).otherwise(c)
        elif f.name not in present:
            c = _default(f)
        elif f.name in _NULLABLE:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.coalesce(F.col(f.name).cast(f.dataType), _default(f))
        cols.append(c.alias(f.name))
    return df.select(*[F.col(k) for k in keep], *cols)


def empty_posts(spark) -> DataFrame:
    return spark.createDataFrame([], POST_SCHEMA)
