"""Chunked work export, enrichment-map scan, streaming ingest and the build
job (K6, W4, P11, S10, U3, R1, R2, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.rulesets import SAMPLE_CATEGORIES
from keepsake.operators import catalog as cat
from keepsake.operators import enrich as E
from keepsake.operators import merge, order
from keepsake.plans import documents as D
from keepsake.plans.registry import register
from keepsake.plans.tables import NOW, content, posts, with_posts
from keepsake.session import scratch_dir
from keepsake.sources import exports as X
from keepsake.sources.files import FILE_ORDER
from keepsake.streaming import capture as C

CHUNKS = 4
WORK_ITEM = ["id", "url", "author_handle", "author_name", "text", "hashtags", "links"]


def work_items(p, force: bool = False):
    """The 7-column work item of each target post."""
    return E.select_targets(p, force).select(*WORK_ITEM)


@register("dump_chunks", with_posts(f"""
SELECT id, url, CAST((row_number() OVER (ORDER BY id) - 1) % {CHUNKS} AS INTEGER) AS chunk
FROM posts WHERE NOT enriched AND enrich_error = ''"""))
def dump_chunks_q(spark, sf_dir):
    """Pending work split round-robin over id order into N chunks."""
    w = order.round_robin_chunks(work_items(posts(spark, sf_dir)), CHUNKS)
    return w.select("id", "url", "chunk")


def write_chunks(chunked, path: str) -> None:
    """One JSON directory per chunk (empty chunks simply do not appear)."""
    chunked.write.mode("errorifexists").partitionBy("chunk").json(path)


def mapping_documents(spark, sf_dir):
    """Two enrichment files per 20 documents: an object keyed by id (even
    doc_ids, plus a non-object value to ignore) and a later list (doc_id % 6 = 0
    overridden, plus entries with falsy ids to ignore)."""
    d = D._docs(spark, sf_dir)
    entry = F.struct(F.col("text").alias("summary"), F.col("lang").alias("topic"),
                     F.array(F.upper("lang"), F.lit(" "), F.col("source")).alias("tags"))
    keyed = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('": '), F.to_json(entry))
    a = (d.where(F.col("doc_id") % 2 == 0).groupBy("g")
         .agg(F.sort_array(F.collect_list(F.struct("doc_id", keyed.alias("j")))).alias("xs"))
         .select("g", F.concat(F.lit("{"), F.array_join(F.transform("xs", lambda x: x["j"]), ", "),
                               F.lit(', "junk": 5}')).alias("value")))
    over = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"),
                              F.concat(F.lit("override "), F.col("doc_id").cast("string")).alias("summary"),
                              F.lit(" Topic ").alias("topic"), F.lit("not a list").alias("tags")))
    b = (d.where(F.col("doc_id") % 6 == 0).groupBy("g")
         .agg(F.sort_array(F.collect_list(F.struct("doc_id", over.alias("j")))).alias("xs"))
         .select("g", F.concat(F.lit('[{"id": "", "summary": "x"}, '),
                               F.array_join(F.transform("xs", lambda x: x["j"]), ", "),
                               F.lit(', {"id": 0, "summary": "y"}, 7]')).alias("value")))
    fa = a.select(F.lit(0).cast("bigint").alias("file_ord"), F.concat(F.lit("mapA/"), F.col("g").cast("string"))
                  .alias("path"), "value")
    fb = b.select(F.lit(1).cast("bigint").alias("file_ord"), F.concat(F.lit("mapB/"), F.col("g").cast("string"))
                  .alias("path"), "value")
    return fa.unionByName(fb)


@register("scan_enrichment_map", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 6 = 0 THEN 'override ' || CAST(doc_id AS VARCHAR) ELSE text END AS summary,
       CASE WHEN doc_id % 6 = 0 THEN ' Topic ' ELSE lang END AS topic,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE upper(lang) || '| |' || source END AS tags
FROM documents WHERE doc_id % 2 = 0""")
def scan_enrichment_map_q(spark, sf_dir):
    """Enrichment files (object by id or list with ids); later file wins."""
    from keepsake.operators.merge import dedupe_last
    ent = X.mapping_entries(mapping_documents(spark, sf_dir))
    m = dedupe_last(ent, "id", list(X.MAP_ORDER))
    return m.select("id", "summary", "topic", F.array_join("tags", "|").alias("tags"))


@register("files_mapping", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 6 = 0 THEN 'override ' || CAST(doc_id AS VARCHAR) ELSE text END AS summary,
       CASE WHEN doc_id % 6 = 0 THEN ' Topic ' ELSE lang END AS topic,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE upper(lang) || '| |' || source END AS tags
FROM documents WHERE doc_id % 2 = 0""")
def files_mapping_q(spark, sf_dir):
    """Enrichment files written with line breaks, read in the given order."""
    from keepsake.plans.q_sources import written_documents

    docs = mapping_documents(spark, sf_dir)
    folders = [written_documents(spark, docs.where(F.col("file_ord") == i)) for i in (0, 1)]
    return X.load_mapping(spark, folders).select("id", "summary", "topic", F.array_join("tags", "|").alias("tags"))


@register("large_mapping", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 6 = 0 THEN 'override ' || CAST(doc_id AS VARCHAR) ELSE text END AS summary,
       CASE WHEN doc_id % 6 = 0 THEN ' Topic ' ELSE lang END AS topic,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE upper(lang) || '| |' || source END AS tags
FROM documents WHERE doc_id % 2 = 0""")
def large_mapping_q(spark, sf_dir):
    """The same files, each read by several tasks."""
    from keepsake.plans.q_sources import written_documents

    docs = mapping_documents(spark, sf_dir)
    folders = [written_documents(spark, docs.where(F.col("file_ord") == i)) for i in (0, 1)]
    found = X.load_mapping(spark, folders, large=1)
    return found.select("id", "summary", "topic", F.array_join("tags", "|").alias("tags"))


# -- streaming -----------------------------------------------------------------------------

_STREAM_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN 'NOTE ' || text ELSE text END AS text,
       source AS author_handle, 'extension' AS source
FROM documents"""


def _write_payload_log(spark, sf_dir, path: str) -> None:
    """Payload log: one payload per line, several files (arrival = path order)."""
    p = D.payloads(spark, sf_dir)
    (p.repartitionByRange("file_ord").sortWithinPartitions("file_ord").select("value")
     .write.option("lineSep", "\n").text(path))


@register("stream_ingest", _STREAM_SQL)
def stream_ingest_q(spark, sf_dir):
    """Payload log consumed by a streaming job (availableNow): first-wins
    ingest into the store, replay-safe."""
    base = scratch_dir(spark)
    _write_payload_log(spark, sf_dir, base + "/in")
    q = C.start_capture_ingest(spark, base + "/in", base + "/store", base + "/ckpt")
    q.awaitTermination()
    return spark.read.parquet(base + "/store").select("id", "text", "author_handle", "source")


@register("stream_dedupe", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def stream_dedupe_q(spark, sf_dir):
    """Stateful dropDuplicates on id across the stream."""
    base = scratch_dir(spark)
    _write_payload_log(spark, sf_dir, base + "/in")
    q = C.start_stream_dedupe(spark, base + "/in", base + "/out", base + "/ckpt")
    q.awaitTermination()
    return spark.read.parquet(base + "/out").select("id")


@register("stream_dedupe_within", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def stream_dedupe_within_q(spark, sf_dir):
    """The same with state that a watermark bounds."""
    base = scratch_dir(spark)
    _write_payload_log(spark, sf_dir, base + "/in")
    C.start_stream_dedupe(spark, base + "/in", base + "/out", base + "/ckpt", within="1 day").awaitTermination()
    return spark.read.parquet(base + "/out").select("id")


# -- the build job ------------------------------------------------------------------------


def build(spark, sf_dir, now: str = NOW):
    """ingest (all capture formats) -> enrich pending (rules, backfill) -> catalog."""
    store = posts(spark, sf_dir).where(F.col("id").cast("bigint") % 2 == 0)
    incoming = X.posts_from_documents(D.mixed_documents(spark, sf_dir))
    merged, added = merge.ingest_additive(store, incoming.drop("format"), list(FILE_ORDER) + ["pos"])
    enriched = E.enrich_pending(merged, E.rules_enricher(SAMPLE_CATEGORIES), now=now,
                                content=content(spark, sf_dir))
    return enriched, added


@register("build_catalog")
def build_catalog_q(spark, sf_dir):
    """End-to-end build: catalog entries of the enriched, merged store."""
    enriched, _ = build(spark, sf_dir)
    return cat.catalog_entries(E.drop_status(enriched))


@register("build_stats", """
SELECT CAST(count_if(NOT (doc_id % 2 = 1 AND doc_id % 91 = 0)) AS BIGINT) AS n_posts,
       CAST(count_if(doc_id % 2 = 1 AND doc_id % 91 <> 0) AS BIGINT) AS added FROM documents""")
def build_stats_q(spark, sf_dir):
    """Posts after the additive ingest and how many the ingest added."""
    enriched, added = build(spark, sf_dir)
    both = enriched.select(F.lit(0).alias("_k")).unionByName(added.select(F.lit(1).alias("_k")))
    return both.agg(F.count_if(F.col("_k") == 0).alias("n_posts"), F.count_if(F.col("_k") == 1).alias("added"))

