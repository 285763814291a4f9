"""By-tag catalog, tag facet and public listing payload.

The catalog is an explode by tag (posts without tags land in ``untagged``).
Popular tags can hold a large share of all rows, so every writer range-
partitions on ``(tag, id)``: one hot tag spreads over many tasks instead of
landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.core import catalog_line, safe_url, script_safe_json

# The section of posts without tags, the title and the published fields.
UNTAGGED = "untagged"
CATALOG_TITLE = "# Bookmarks catalog"
PUBLIC_FIELDS = ("id", "url", "text", "summary", "topic", "tags",
                 "author_handle", "author_name", "created_at", "metrics")


def by_tag(posts: DataFrame) -> DataFrame:
    """One row per (post, tag); posts with no tags go to ``untagged``.

    Duplicate tags on one post are kept, as the reference lists them twice.
    """
    tags = F.col("tags")
    tag_or_default = F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, tags).otherwise(F.array(F.lit(UNTAGGED)))
    return posts.withColumn("tag", F.explode(tag_or_default))


def catalog_entries(posts: DataFrame) -> DataFrame:
    """(tag, id, line) — one Markdown bullet per post per tag."""
    return by_tag(posts).select("tag", "id", catalog_line().alias("line"))


def catalog_header(posts: DataFrame) -> DataFrame:
    """The catalog's total line counts posts, not entries."""
    return posts.agg(F.count("*").alias("n_posts")).select(
        "n_posts", F.concat(F.col("n_posts").cast("string"), F.lit(" bookmarks.")).alias("header"))


def tag_facet(posts: DataFrame) -> DataFrame:
    """Distinct tags over all posts (``untagged`` contributes none)."""
    return posts.select(F.explode(F.coalesce(F.col("tags"), F.array().cast("array<string>"))).alias("tag")).distinct()


def catalog_document(posts: DataFrame) -> DataFrame:
    """(tag, row, id, line): the lines of the whole catalog, in the order (tag, row, id).

    The title and the total come first (null tag), then per tag a heading
    (row 0) and its posts (row 1).
    """
    entries = catalog_entries(posts).select("tag", F.lit(1).alias("row"), "id", "line")
    heads = entries.select("tag").distinct().select("tag", F.lit(0).alias("row"), F.lit("").alias("id"),
                                                    F.concat(F.lit("## "), F.col("tag")).alias("line"))
    nothing = F.lit(None).cast("string")
    total = catalog_header(posts).select(nothing.alias("tag"), F.lit(1).alias("row"), F.lit("").alias("id"),
                                         F.col("header").alias("line"))
    title = total.select("tag", F.lit(0).alias("row"), "id", F.lit(CATALOG_TITLE).alias("line"))
    return title.unionByName(total).unionByName(heads).unionByName(entries)


def write_catalog(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the catalog as text files whose names are in document order.

    Range partitions on (tag, row, id) split a popular tag over files and need
    no directory per tag.  Rendering again replaces the folder.
    """
    order = [F.col("tag").asc_nulls_first(), F.col("row"), F.col("id")]
    sized = [partitions] if partitions else []
    (catalog_document(posts).repartitionByRange(*sized, *order).sortWithinPartitions(*order)
     .select("line").write.mode("overwrite").text(path))


def public_records(posts: DataFrame) -> DataFrame:
    """Whitelisted fields only, with a neutralised URL."""
    cols = [safe_url("url").alias("url") if c == "url" else F.col(c) for c in PUBLIC_FIELDS]
    return posts.select(*cols)


def public_payload_lines(posts: DataFrame) -> DataFrame:
    """(id, json) — one script-safe JSON object per public record."""
    rec = public_records(posts)
    # metrics keys sorted, as they are after a round trip through the store
    sorted_metrics = F.map_from_entries(F.array_sort(F.map_entries(F.col("metrics"))))
    cols = [sorted_metrics.alias(c) if c == "metrics" else F.col(c) for c in PUBLIC_FIELDS]
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return rec.select("id", script_safe_json(body).alias("json"))


def write_public_payload(posts: DataFrame, path: str) -> None:
    """Public listing data as NDJSON, globally sorted by id."""
    (public_payload_lines(posts).orderBy("id").select(F.col("json").alias("value"))
     .write.mode("overwrite").text(path))
