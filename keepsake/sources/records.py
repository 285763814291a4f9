"""Generic id-keyed record collections.

A record is any JSON object; ``data`` keeps it as JSON text and ``id`` is
``str(record[id_field])``.  Collections share one table keyed by
``(collection, id)`` and partitioned by ``collection`` on disk, so a
collection read is a partition-pruned scan of one directory.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.core import strip_ws
from keepsake.operators.merge import changed_rows, dedupe_last
from keepsake.sources.files import line_order, lines

RECORD_KEY = ["collection", "id"]
MISSING_ID = "record is missing required id field {}"
BACKEND_ENV = "KEEPSAKE_BACKEND"
BACKENDS = ("ndjson", "parquet", "jdbc")


def id_path(id_field: str) -> str:
    return "$['" + id_field.replace("'", "\\'") + "']"


def record_id(data, id_field: str = "id"):
    """``str(record.get(id_field, ""))``; a missing or JSON-null id is ''.

    One variant lookup: filters on the id are pushed below this projection
    by the optimizer and inline the expression, so it must stay small.
    """
    return F.coalesce(F.try_variant_get(data, id_path(id_field), "string"), F.lit(""))


def parse_record_lines(raw: DataFrame, collection, id_field: str = "id",
                       order: Sequence[str] | None = None, require: bool = False) -> DataFrame:
    """(collection, id, data) from JSON lines; blank lines skipped, rows with
    an empty id dropped (or, with ``require``, failing the job), the last line of
    an id wins.  A malformed line fails the read."""
    order = line_order(raw) if order is None else order
    coll = F.lit(collection) if isinstance(collection, str) else collection
    body = raw.where(strip_ws(F.col("value")) != "")
    # one-row generator: the id filter below is not pushed under the parse
    parsed = body.select(*order, coll.alias("collection"),
                         F.inline(F.array(F.struct(F.parse_json("value").alias("_v")))))
    keyed = parsed.select(*order, "collection", record_id(F.col("_v"), id_field).alias("id"),
                          F.to_json("_v").alias("data"))
    keyed = require_ids(keyed, id_field) if require else keyed.where(F.col("id") != "")
    return dedupe_last(keyed, RECORD_KEY, list(order)).drop(*order)


def read_ndjson_collection(spark: SparkSession, collection: str, data_dir: str, id_field: str = "id") -> DataFrame:
    return parse_record_lines(lines(spark, f"{data_dir.rstrip('/')}/{collection}.ndjson"), collection, id_field)


def read_table_collection(spark: SparkSession, path: str, collection: str, id_field: str = "id") -> DataFrame:
    """One collection of a ``partitionBy("collection")`` Parquet table:
    partition pruning keeps the scan to one directory; only ``data`` is read."""
    df = spark.read.parquet(path).where(F.col("collection") == collection).select("data")
    v = F.parse_json("data")
    return df.select(F.lit(collection).alias("collection"), record_id(v, id_field).alias("id"), "data").where(
        F.col("id") != "")


def read_jdbc_collection(spark: SparkSession, url: str, collection: str, table: str = "records",
                         id_field: str = "id", properties: dict | None = None) -> DataFrame:
    """The same from a relational ``records(collection, id, data, updated_at)``
    table; the collection predicate and the projection are pushed down."""
    df = spark.read.jdbc(url, table, properties=properties or {})
    df = df.where(F.col("collection") == collection).select("data")
    v = F.parse_json(F.col("data").cast("string"))
    return df.select(F.lit(collection).alias("collection"), record_id(v, id_field).alias("id"),
                     F.col("data").cast("string").alias("data")).where(F.col("id") != "")


def open_collection(spark: SparkSession, collection: str, backend: str | None = None, **kw) -> DataFrame:
    """Front door: backend from the argument, else ``$KEEPSAKE_BACKEND``, else
    ndjson.  ``kw``: ``data_dir`` (ndjson), ``path`` (parquet), ``url``/``table``
    (jdbc), ``id_field``."""
    b = (backend or os.environ.get(BACKEND_ENV) or "ndjson").lower()
    id_field = kw.get("id_field", "id")
    if b == "ndjson":
        return read_ndjson_collection(spark, collection, kw.get("data_dir", "data"), id_field)
    if b == "parquet":
        return read_table_collection(spark, kw["path"], collection, id_field)
    if b == "jdbc":
        return read_jdbc_collection(spark, kw["url"], collection, kw.get("table", "records"), id_field,
                                    kw.get("properties"))
    raise ValueError(f"unknown backend {b!r} (expected one of {', '.join(BACKENDS)})")


def require_ids(records: DataFrame, id_field: str = "id") -> DataFrame:
    """Fail the job when a record to write has no id."""
    return records.withColumn("id", F.when(F.coalesce(F.col("id"), F.lit("")) == "",
                                           F.raise_error(F.lit(MISSING_ID.format(id_field))))
                              .otherwise(F.col("id")))


def upsert_records(current: DataFrame, incoming: DataFrame, batch_ts: str):
    """Changed-rows-only upsert.  Returns ``(merged, dirty)``.

    ``dirty`` holds incoming records that are new or differ (by content hash)
    from the current ones, with ``updated_at`` = ``batch_ts``; an unchanged
    batch yields no dirty rows and rewrites nothing.
    """
    inc = require_ids(incoming).select(*RECORD_KEY, "data")
    cur = current.select(*RECORD_KEY, "data", *(["updated_at"] if "updated_at" in current.columns else []))
    if "updated_at" not in cur.columns:
        cur = cur.withColumn("updated_at", F.lit(None).cast("string"))
    dirty = changed_rows(cur.select(*RECORD_KEY, "data"), inc, RECORD_KEY, ["data"]).withColumn(
        "updated_at", F.lit(batch_ts))
    kept = cur.join(dirty.select(*RECORD_KEY), RECORD_KEY, "left_anti")
    return kept.unionByName(dirty), dirty


def write_collections(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(collection, id, data, updated_at)`` partitioned by collection.

    Range partitions by (collection, id): a task writes to few collections, a
    large collection spreads over tasks, ids are sorted across its files.
    """
    (records.repartitionByRange("collection", "id").sortWithinPartitions("collection", "id")
     .write.mode(mode).partitionBy("collection").parquet(path))


def copy_collection(source: DataFrame, path: str, collection: str, batch_ts: str, mode: str = "append") -> None:
    """Copy the records of ``source`` into a collection of the table at ``path``."""
    out = source.select(F.lit(collection).alias("collection"), "id", "data", F.lit(batch_ts).alias("updated_at"))
    write_collections(out, path, mode)
