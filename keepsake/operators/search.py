"""Listing search: tag filter, all-token text search, counts.

The haystack is a materialisable column (``search_haystack``); a query is a
plain predicate, so it runs as a filter inside the scan stage and, on a
snapshot that stores ``hay``, reads one column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.core import search_haystack, strip_ws

BLANKS = r"(?U)\s+"


def query_tokens(q: str | None) -> list[str]:
    """Trimmed, lower-cased, split on whitespace; empty query -> no tokens."""
    q = (q or "").strip().lower()
    return re.split(r"\s+", q) if q else []


def with_haystack(posts: DataFrame, name: str = "hay") -> DataFrame:
    return posts.withColumn(name, search_haystack())


def match_tag(tag: str | None) -> Column:
    """Exact membership of the active tag (no tag = everything)."""
    if tag is None:
        return F.lit(True)
    return F.coalesce(F.array_contains(F.coalesce(F.col("tags"), F.array().cast("array<string>")), tag),
                      F.lit(False))


def match_text(q: str | None, hay: Column | None = None) -> Column:
    """Every token of ``q`` is a substring of the haystack."""
    hay = search_haystack() if hay is None else hay
    cond = F.lit(True)
    for w in query_tokens(q):
        cond = cond & hay.contains(w)
    return cond


def match_text_column(q: Column, hay: Column | None = None) -> Column:
    """The same with the query taken from a column (one query per row)."""
    hay = search_haystack() if hay is None else hay
    norm = F.lower(strip_ws(F.coalesce(q, F.lit(""))))
    tokens = F.split(norm, BLANKS)
    return (norm == "") | F.forall(tokens, lambda w: hay.contains(w))


def search(posts: DataFrame, q: str | None = None, tag: str | None = None) -> DataFrame:
    return posts.where(match_tag(tag) & match_text(q))


def search_counts(posts: DataFrame, q: str | None = None, tag: str | None = None) -> DataFrame:
    """One row: (shown, total)."""
    m = match_tag(tag) & match_text(q)
    return posts.agg(F.count_if(m).alias("shown"), F.count("*").alias("total"))
