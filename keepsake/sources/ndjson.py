"""NDJSON post store: scan (S1) and deterministic sink (K1).

Lines are split on ``\\n`` only; blank lines are skipped; a malformed line
fails the read (FAILFAST) like the original loader; when an id repeats the
last line wins.  The sink writes one JSON object per line with every field
present (nulls kept), keys sorted, rows sorted by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.core import strip_ws
from keepsake.operators.merge import dedupe_last
from keepsake.schema import POST_FIELDS, POST_SCHEMA, conform_posts
from keepsake.sources.files import line_order, lines


def parse_post_lines(raw: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Parse a ``value`` column of JSON lines into conformed posts, last wins."""
    order = line_order(raw) if order is None else order
    body = raw.where(strip_ws(F.col("value")) != "")
    parsed = body.select(*order, F.from_json("value", POST_SCHEMA, {"mode": "FAILFAST"}).alias("p"))
    flat = parsed.select(*order, *[F.col("p." + f).alias(f) for f in POST_FIELDS])
    last = dedupe_last(flat, "id", list(order)).drop(*order)
    return conform_posts(last)


def read_posts(spark: SparkSession, paths) -> DataFrame:
    """Load a post store written as NDJSON."""
    return parse_post_lines(lines(spark, paths))


def to_json_lines(posts: DataFrame) -> DataFrame:
    """(id, value): the deterministic JSON line of every post.

    Keys are sorted at every level: struct fields are declared in order and
    the metrics map is rebuilt from its key-sorted entries.
    """
    sorted_metrics = F.map_from_entries(F.array_sort(F.map_entries(F.col("metrics"))))
    cols = [sorted_metrics.alias(f) if f == "metrics" else F.col(f) for f in POST_FIELDS]
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return posts.select("id", body.alias("value"))


def write_posts(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write sorted NDJSON (range-partitioned by id: part files concatenate in
    id order)."""
    df = to_json_lines(posts)
    n = partitions or int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, "id").sortWithinPartitions("id").select("value")
     .write.mode("errorifexists").option("lineSep", "\n").text(path))
