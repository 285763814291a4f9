"""Record-store queries.

Records are derived from ``events``: collection = event_type, record id =
user_id, the record object carries the event id and the event's props; the
last event of a (collection, id) wins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.plans.registry import register
from keepsake.plans.tables import table
from keepsake.session import scratch_dir
from keepsake.sources import exports as X
from keepsake.sources import records as R

BATCH_TS = "2025-01-01T00:00:00+00:00"
BUMP = 1000

_LAST = """
(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k0 FROM (
   SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events)
 WHERE rn = 1)"""


def record_json(k: F.Column | None = None) -> F.Column:
    props = F.parse_json("props") if k is None else F.parse_json(F.concat(F.lit('{"k": '), k.cast("string"),
                                                                       F.lit("}")))
    return F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("event"),
                              props.alias("props"), F.col("event_type").alias("type")))


def record_lines(spark, sf_dir, bump: bool = False):
    """(path, block, line_no, value) lines of every collection."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    k = F.when(F.col("user_id") % 3 == 0, k + BUMP).otherwise(k) if bump else None
    return ev.select(F.col("event_type").alias("path"), F.lit(0).cast("bigint").alias("block"),
                     F.col("event_id").alias("line_no"), record_json(k).alias("value"))


def records(spark, sf_dir, bump: bool = False):
    return R.parse_record_lines(record_lines(spark, sf_dir, bump), F.col("path"))


def _fields(df):
    return df.select("collection", "id", F.get_json_object("data", "$.event").cast("bigint").alias("event"),
                     F.get_json_object("data", "$.props.k").cast("bigint").alias("k"))


@register("scan_records", f"""
SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS id, event_id AS event, k0 AS k FROM {_LAST}""")
def scan_records_q(spark, sf_dir):
    """Dynamic JSON records, id from the object, last line of an id wins."""
    return _fields(records(spark, sf_dir))


@register("scan_collection", f"""
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS event FROM {_LAST} WHERE event_type = 'click'""")
def scan_collection_q(spark, sf_dir):
    """One collection of the partitioned record table (partition pruning)."""
    path = scratch_dir(spark) + "/records"
    R.write_collections(records(spark, sf_dir).withColumn("updated_at", F.lit(BATCH_TS)), path)
    one = R.open_collection(spark, "click", backend="parquet", path=path)
    return one.select("id", F.get_json_object("data", "$.event").cast("bigint").alias("event"))


@register("collection_isolation", """
SELECT event_type AS collection, count(DISTINCT user_id) AS n_ids FROM events GROUP BY event_type""")
def collection_isolation_q(spark, sf_dir):
    """The same id lives in several collections without colliding."""
    return records(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n_ids"))


@register("changed_rows_upsert", f"""
SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS id, k0 + {BUMP} AS k, '{BATCH_TS}' AS updated_at
FROM {_LAST} WHERE user_id % 3 = 0""")
def changed_rows_upsert_q(spark, sf_dir):
    """Only records whose content changed are written (with the batch time)."""
    cur = records(spark, sf_dir)
    inc = records(spark, sf_dir, bump=True)
    _, dirty = R.upsert_records(cur, inc, BATCH_TS)
    return dirty.select("collection", "id", F.get_json_object("data", "$.props.k").cast("bigint").alias("k"),
                        "updated_at")


@register("copy_collection", f"""
SELECT event_type AS collection, count(*) AS n, CAST(0 AS BIGINT) AS dirty_again FROM {_LAST} GROUP BY event_type""")
def copy_collection_q(spark, sf_dir):
    """NDJSON collections copied into the partitioned table; a second copy
    changes nothing."""
    base = scratch_dir(spark)
    src = base + "/ndjson"
    (record_lines(spark, sf_dir).select(F.col("path").alias("collection"), "line_no", "value")
     .repartitionByRange("collection", "line_no").sortWithinPartitions("collection", "line_no")
     .select("collection", "value")
     .write.partitionBy("collection").option("lineSep", "\n").text(src))
    raw = (spark.read.option("lineSep", "\n").text(src)
           .select("collection", F.lit(0).alias("file_ord"), F.col("_metadata.file_path").alias("path"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("line_no"), "value"))
    loaded = R.parse_record_lines(raw, F.col("collection"))
    empty = loaded.limit(0).withColumn("updated_at", F.lit(None).cast("string"))
    merged, _ = R.upsert_records(empty, loaded, BATCH_TS)
    dst = base + "/table"
    R.write_collections(merged, dst)
    copied = spark.read.parquet(dst)
    _, dirty_again = R.upsert_records(copied, loaded, BATCH_TS)
    counts = copied.groupBy("collection").agg(F.count("*").alias("n"))
    again = dirty_again.groupBy("collection").agg(F.count("*").alias("dirty_again"))
    return counts.join(again, "collection", "left").select(
        "collection", "n", F.coalesce("dirty_again", F.lit(0)).cast("bigint").alias("dirty_again"))


@register("scan_put_input", """
SELECT CAST(user_id AS VARCHAR) AS id, event_id AS event FROM events""")
def scan_put_input_q(spark, sf_dir):
    """Put input: one object or an array of objects per document."""
    ev = table(spark, sf_dir, "events").withColumn("p", (F.col("event_id") / 2).cast("bigint"))
    obj = record_json()
    pairs = (ev.where(F.col("p") % 2 == 0).groupBy("p")
             .agg(F.sort_array(F.collect_list(F.struct("event_id", obj.alias("j")))).alias("xs"))
             .select(F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["j"]), ", "), F.lit("]"))
                     .alias("value")))
    singles = ev.where(F.col("p") % 2 == 1).select(obj.alias("value"))
    docs = pairs.unionByName(singles)
    items = docs.select(F.explode(X.record_items(F.col("value"))).alias("v"))
    return items.select(R.record_id(F.col("v")).alias("id"),
                        F.try_variant_get("v", "$.event", "bigint").alias("event"))


@register("lookup_record", f"""
SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS id, event_id AS event FROM {_LAST}
WHERE user_id = 42""")
def lookup_record_q(spark, sf_dir):
    """Point lookup of one record id in every collection."""
    r = records(spark, sf_dir).where(F.col("id") == "42")
    return r.select("collection", "id", F.get_json_object("data", "$.event").cast("bigint").alias("event"))
