"""Incremental enrichment as a stream over a store's commits (R1 with R3).

Source: the store's log, a row per committed version, read as a file stream; a segment
that was never committed is never seen.  Each micro-batch takes the versions that are
new, reads the posts that they appended, as the store holds them now, enriches those
that are pending and writes them as one update.  Updates (its own as well) bring no
new posts and are passed over.

A replayed batch finds its posts enriched already and commits nothing; so does a batch
whose commit succeeded but whose checkpoint did not.  Posts with a recorded error aren't
pending and aren't tried again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.jobs import batch_time
from keepsake.operators import enrich as E
from keepsake.session import written
from keepsake.sources.snapshot import LOG_SCHEMA, SnapshotStore

#: Log files, that is commits, that one micro-batch takes at most.
MAX_COMMITS = 100


def enrich_commits(commits: DataFrame, store: SnapshotStore, enricher: Callable[[DataFrame], DataFrame],
                   now: str | None = None) -> int | None:
    """Enrich what the given log rows appended; returns the version written, None if nothing was pending."""
    rows = commits.select("version", "updates").collect()  # a row per commit
    names = [store.segment_name(r.version) for r in rows if store.segment_name(r.version) not in (r.updates or [])]
    current = store.read_keys_of(names) if names else None
    if current is None:
        return None
    done, _ = E.split_enrich(current, enricher, now=now or batch_time())
    touched = written(done.where("_status is not null"))
    return None if touched.isEmpty() else store.update(E.drop_status(touched))


def start_enrichment(spark: SparkSession, root: str, checkpoint: str, enricher: Callable[[DataFrame], DataFrame],
                     now: str | None = None, available_now: bool = True):
    """Start the enrichment stream of the store at ``root`` (``availableNow`` works off what is there and stops)."""
    store = SnapshotStore(spark, root)
    log = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", MAX_COMMITS).parquet(root.rstrip("/") + "/_log")
    query = (log.writeStream.foreachBatch(lambda batch, _: enrich_commits(batch, store, enricher, now) and None)
             .option("checkpointLocation", checkpoint))
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime="10 seconds")
    return query.start()
