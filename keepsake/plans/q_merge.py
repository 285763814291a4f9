"""Keyed merge and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.operators import merge, order
from keepsake.operators.enrich import pending, select_targets
from keepsake.plans.registry import register
from keepsake.plans.tables import changes, incoming, posts, table, with_posts
from keepsake.session import scratch_dir
from keepsake.sources.snapshot import SnapshotStore

LIMIT_TARGETS = 25


@register("ingest_additive", with_posts("""
SELECT id, text, url FROM posts
UNION ALL
SELECT CAST(doc_id + 1000000 AS VARCHAR) AS id, text, url FROM posts WHERE doc_id % 2 = 0"""))
def ingest_additive_q(spark, sf_dir):
    merged, _ = merge.ingest_additive(posts(spark, sf_dir), incoming(spark, sf_dir), ["batch", "pos"])
    return merged.select("id", "text", "url")


@register("ingest_added_count", with_posts(
    "SELECT count(*) AS added FROM posts WHERE doc_id % 2 = 0"))
def ingest_added_count_q(spark, sf_dir):
    _, added = merge.ingest_additive(posts(spark, sf_dir), incoming(spark, sf_dir), ["batch", "pos"])
    return added.agg(F.count("*").alias("added"))


@register("ingest_idempotent", with_posts("SELECT count(*) AS n_rows, 0 AS added_again FROM posts"))
def ingest_idempotent_q(spark, sf_dir):
    """Ingesting a batch whose ids are all stored adds nothing."""
    store = posts(spark, sf_dir)
    again = store.withColumn("batch", F.lit(1)).withColumn("pos", F.col("id").cast("bigint"))
    merged, added = merge.ingest_additive(store, again, ["batch", "pos"])
    both = merged.select(F.lit(0).alias("_k")).unionByName(added.select(F.lit(1).alias("_k")))
    return both.agg(F.count_if(F.col("_k") == 0).alias("n_rows"),
                    F.count_if(F.col("_k") == 1).cast("int").alias("added_again"))


@register("upsert_by_key", with_posts("""
SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'updated ' || id ELSE summary END AS summary, text FROM posts"""))
def upsert_by_key_q(spark, sf_dir):
    out = merge.upsert(posts(spark, sf_dir), changes(spark, sf_dir), order=["seq"])
    return out.select("id", "summary", "text")


@register("merge_on_read", with_posts("""
SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'updated ' || id ELSE summary END AS summary, text FROM posts"""))
def merge_on_read_q(spark, sf_dir):
    """The same changes written as an update segment of a store and merged by the reader."""
    store = SnapshotStore(spark, scratch_dir(spark) + "/store")
    base = posts(spark, sf_dir)
    store.commit(base)
    store.update(merge.dedupe_last(changes(spark, sf_dir), "id", ["seq"]).select(*base.columns))
    return store.read().select("id", "summary", "text")


_FIRST_SQL = """
SELECT user_id, event_id, event_type, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {dir}) AS rn FROM events) WHERE rn = 1"""


@register("dedupe_first", _FIRST_SQL.format(dir="ASC"))
def dedupe_first_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return merge.dedupe_first(ev.withColumn("_o", F.col("event_id")), "user_id", ["_o"]).drop("_o")


@register("dedupe_last", _FIRST_SQL.format(dir="DESC"))
def dedupe_last_q(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return merge.dedupe_last(ev.withColumn("_o", F.col("event_id")), "user_id", ["_o"]).drop("_o")


@register("changed_rows_only", with_posts(
    "SELECT id, 'updated ' || id AS summary FROM posts WHERE doc_id % 4 = 0"))
def changed_rows_only_q(spark, sf_dir):
    """Dirty set of an upsert: unchanged candidates are dropped by content hash."""
    base = posts(spark, sf_dir).select("id", "summary", "text")
    cand = (posts(spark, sf_dir)
            .withColumn("summary", F.when(F.col("id").cast("bigint") % 4 == 0,
                                          F.concat(F.lit("updated "), F.col("id"))).otherwise(F.col("summary")))
            .select("id", "summary", "text"))
    return merge.changed_rows(base, cand, "id", ["summary", "text"]).select("id", "summary")


@register("pending", with_posts("SELECT id FROM posts WHERE NOT enriched AND enrich_error = ''"))
def pending_q(spark, sf_dir):
    return pending(posts(spark, sf_dir)).select("id")


@register("select_targets", with_posts("""
SELECT 'pending' AS mode, id FROM posts WHERE NOT enriched AND enrich_error = ''
UNION ALL SELECT 'force' AS mode, id FROM posts"""))
def select_targets_q(spark, sf_dir):
    p = posts(spark, sf_dir)
    return (select_targets(p, force=False).select(F.lit("pending").alias("mode"), "id")
            .unionByName(select_targets(p, force=True).select(F.lit("force").alias("mode"), "id")))


@register("list_all", with_posts("SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM posts"))
def list_all_q(spark, sf_dir):
    return order.global_position(posts(spark, sf_dir).select("id"), ["id"])


@register("sort_recent", with_posts(
    "SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS pos FROM posts"))
def sort_recent_q(spark, sf_dir):
    p = posts(spark, sf_dir).select("id", "created_at")
    return order.global_position(p, order.recent_order())


@register("sort_likes", with_posts(
    "SELECT id, likes, row_number() OVER (ORDER BY likes DESC, id) - 1 AS pos FROM posts"))
def sort_likes_q(spark, sf_dir):
    p = posts(spark, sf_dir).select("id", "metrics")
    out = order.global_position(p, order.metric_order("likes"))
    return out.select("id", F.col("metrics")["likes"].alias("likes"), "pos")


@register("sort_views", with_posts(
    "SELECT id, views, row_number() OVER (ORDER BY views DESC, id) - 1 AS pos FROM posts"))
def sort_views_q(spark, sf_dir):
    p = posts(spark, sf_dir).select("id", "metrics")
    out = order.global_position(p, order.metric_order("views"))
    return out.select("id", F.col("metrics")["views"].alias("views"), "pos")


@register("top_liked", with_posts(
    "SELECT id, likes, CAST(row_number() OVER (ORDER BY likes DESC, id) AS BIGINT) AS rank "
    "FROM posts ORDER BY likes DESC, id LIMIT 10"))
def top_liked_q(spark, sf_dir):
    """Top-10 report (the limit is the feature)."""
    p = posts(spark, sf_dir).select("id", F.col("metrics")["likes"].alias("likes"))
    return order.top_k(p, [F.col("likes").desc(), F.col("id")], 10)


@register("limit_targets", with_posts(f"""
SELECT id, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS rank FROM posts
WHERE NOT enriched AND enrich_error = '' ORDER BY id LIMIT {LIMIT_TARGETS}"""))
def limit_targets_q(spark, sf_dir):
    t = order.limit_targets(pending(posts(spark, sf_dir)).select("id"), LIMIT_TARGETS)
    return order.top_k(t, ["id"], LIMIT_TARGETS)


@register("lookup_id", with_posts("SELECT id, url, text FROM posts WHERE id = '42'"))
def lookup_id_q(spark, sf_dir):
    """Point lookup by string id."""
    return posts(spark, sf_dir).where(F.col("id") == F.lit("42")).select("id", "url", "text")
