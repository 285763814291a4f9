"""Incremental capture ingest as a Structured Streaming job.

Source: a directory of payload logs (one raw timeline payload per line).
Each micro-batch: extract results -> normalise -> first-wins per id inside
the batch -> anti-join with the store -> append.  The state of the de-dup is
the store itself (no unbounded state store), and a replayed batch adds
nothing because its ids are already stored — the sink is idempotent, so the
checkpoint + replay give exactly-once results.

``start_stream_dedupe`` is the state-store alternative: every id once across batches,
with state that grows with the number of ids or, on request, is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.operators.merge import dedupe_first
from keepsake.operators.normalize import capture_to_posts, normalize_results
from keepsake.sources.files import path_exists
from keepsake.sources.payloads import extract_results

ORDER = ["batch", "path", "block", "line_no", "pos"]


#: Files that one micro-batch takes at most, so that a backlog is worked off in steps.
MAX_FILES = 1000


def payload_stream(spark: SparkSession, source_dir: str, max_files: int | None = MAX_FILES) -> DataFrame:
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(source_dir).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("captured"), "value")


def _store_ids(spark: SparkSession, store_path: str) -> DataFrame | None:
    """Stored ids, or None before the first batch; any other failure to read is raised."""
    return spark.read.parquet(store_path).select("id") if path_exists(spark, store_path) else None


def ingest_batch(batch: DataFrame, batch_id: int, store_path: str, captured_at: str = "") -> int:
    """foreachBatch body: add unseen ids of one micro-batch to the store.

    The store is probed with the batch's ids, which Spark broadcasts below its
    own size limit; the batch is then anti-joined against the few ids found.
    """
    spark = batch.sparkSession
    lines = batch.withColumn("line_no", F.monotonically_increasing_id()).withColumn("batch", F.lit(batch_id))
    results = extract_results(lines).select(*ORDER, "result")
    caps = normalize_results(results, "result", captured_at).where(F.col("id").isNotNull() & (F.col("id") != ""))
    firsts = dedupe_first(caps, "id", ORDER).persist()
    try:
        n = firsts.count()
        if n == 0:
            return batch_id
        store = _store_ids(spark, store_path)
        new = firsts
        if store is not None:
            ids = firsts.select("id")
            present = store.join(ids, "id", "left_semi")
            new = firsts.join(present, "id", "left_anti")
        capture_to_posts(new, keep=["batch"]).write.mode("append").parquet(store_path)
    finally:
        firsts.unpersist()
    return batch_id


def start_capture_ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str,
                         captured_at: str = "", available_now: bool = True):
    """Start the ingest stream (``availableNow`` processes what is there and stops)."""
    q = (payload_stream(spark, source_dir).writeStream
         .foreachBatch(lambda df, bid: ingest_batch(df, bid, store_path, captured_at))
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def start_stream_dedupe(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
                        within: str | None = None, max_files: int | None = MAX_FILES):
    """Distinct captured ids across the stream via the state store.

    Without ``within`` an id is given once, however late it comes again, and the state
    grows with the number of ids.  With it (an interval such as ``"2 hours"``) an id
    is remembered for that long after the time at which it was captured (that of its
    log file): copies that arrive within it are dropped, the state holds no older ids,
    and a copy that is later than the watermark is dropped unseen.
    """
    lines = payload_stream(spark, source_dir, max_files)
    results = extract_results(lines)
    captured = F.col("captured")
    ids = normalize_results(results.select(captured, "result"), "result").select("id", captured).where(
        F.col("id").isNotNull() & (F.col("id") != ""))
    if within is None:
        distinct = ids.select("id").dropDuplicates(["id"])
    else:
        distinct = ids.withWatermark("captured", within).dropDuplicatesWithinWatermark(["id"]).select("id")
    return (distinct.writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
