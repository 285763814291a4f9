"""Batch jobs over a snapshot store: ingest, enrich, render, build.

Each job reads the latest committed snapshot, writes what it changes once to the
shared scratch folder, counts that, and commits it: new posts and records as one
more segment, changed ones as a segment that replaces them on reading.  Stored files
stay as they are; ``fold`` merges the segments.  A run without changes commits
nothing.

    spark-submit -m keepsake.jobs build --store s3://bucket/posts --out s3://bucket/site captures/*.json
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keepsake.operators import catalog as cat
from keepsake.operators import enrich as E
from keepsake.operators import merge
from keepsake.schema import POST_FIELDS, empty_posts
from keepsake.session import written
from keepsake.sources.exports import read_captures
from keepsake.sources.files import FILE_ORDER
from keepsake.sources.snapshot import SnapshotStore


def batch_time() -> str:
    """The time stamped on a run's rows when the caller gives none: UTC, ISO 8601."""
    return datetime.now(tz=UTC).isoformat(timespec="microseconds")


def _current(store: SnapshotStore) -> DataFrame:
    df = store.read()
    return df if df is not None else empty_posts(store.spark)


def ingest_job(spark: SparkSession, store_root: str, paths) -> dict:
    """Add unseen posts from capture files (any format); first occurrence wins.

    The new posts become a segment of the store; of stored segments only those that
    may hold one of the ids are read, and of those the ids.  Without new posts no
    version is written.
    """
    store = SnapshotStore(spark, store_root)
    incoming = read_captures(spark, paths).drop("format")
    batch = written(merge.dedupe_first(incoming, "id", [*FILE_ORDER, "pos"]).select(*POST_FIELDS))
    added = written(batch.join(store.present(batch), "id", "left_anti").select(*POST_FIELDS))
    n = added.count()
    return {"added": n, "version": store.append(added) if n else store.latest_version()}


def enrich_job(spark: SparkSession, store_root: str, enricher=None, *, content: DataFrame | None = None,
               fetcher=None, limit: int | None = None, force: bool = False, offline: bool = False,
               now: str | None = None) -> dict:
    """Enrich pending (or all, with ``force``) posts and commit the result; nothing touched, no new version."""
    store = SnapshotStore(spark, store_root)
    chosen = E.ENRICHERS[enricher]() if isinstance(enricher, str) else enricher or E.rules_enricher()
    done, _ = E.split_enrich(_current(store), chosen, now=now or batch_time(), force=force,
                                limit=limit, content=content, fetcher=fetcher, offline=offline)
    touched = written(done.where("_status is not null"))
    stats = E.enrich_stats(touched).first()
    version = store.update(E.drop_status(touched)) if stats.enriched + stats.errors else store.latest_version()
    return {"enriched": int(stats.enriched), "errors": int(stats.errors), "version": version}


def render_job(spark: SparkSession, store_root: str, out_dir: str) -> dict:
    """Write the by-tag catalog and the public listing data of the latest snapshot."""
    posts = _current(SnapshotStore(spark, store_root))
    out = out_dir.rstrip("/")
    cat.write_catalog(posts, out + "/catalog")
    cat.write_public_payload(posts, out + "/site")
    header = cat.catalog_header(posts).first()
    return {"posts": int(header.n_posts), "catalog": out + "/catalog", "site": out + "/site"}


def build_job(spark: SparkSession, store_root: str, out_dir: str, paths=(), **enrich_kw) -> dict:
    stats = {}
    if paths:
        stats["ingest"] = ingest_job(spark, store_root, paths)
    stats["enrich"] = enrich_job(spark, store_root, **enrich_kw)
    stats["render"] = render_job(spark, store_root, out_dir)
    return stats


# -- offline enrichment: dump work, apply results ------------------------------------------


def dump_job(spark: SparkSession, store_root: str, out_dir: str, chunks: int = 1, force: bool = False) -> dict:
    """Write pending (or all) work items as JSON, split round-robin over id order."""
    from keepsake.operators.order import round_robin_chunks

    posts = _current(SnapshotStore(spark, store_root))
    items = E.select_targets(posts, force).select("id", "url", "author_handle", "author_name", "text",
                                                   "hashtags", "links")
    obs = Observation("dump")
    chunked = round_robin_chunks(items, chunks).observe(obs, F.count(F.lit(1)).alias("pending"))
    chunked.write.mode("errorifexists").partitionBy("chunk").json(out_dir)
    return {"pending": int(obs.get["pending"]), "out": out_dir}


def apply_job(spark: SparkSession, store_root: str, mapping_paths, force: bool = False,
              now: str | None = None) -> dict:
    """Apply enrichment files (object by id, or list with ids; later wins).
    Ids without an entry get a per-row error; an empty mapping is rejected."""
    from keepsake.sources.exports import load_mapping

    mapping = load_mapping(spark, mapping_paths)
    if mapping.isEmpty():
        raise ValueError("no enrichments found in inputs")
    return enrich_job(spark, store_root, E.mapping_enricher(mapping), force=force, offline=True, now=now)


# -- generic record collections ------------------------------------------------------------


def _record_store(spark: SparkSession, root: str) -> SnapshotStore:
    return SnapshotStore(spark, root, key="id", partition_by="collection")


def record_put(spark: SparkSession, root: str, collection: str, paths, id_field: str = "id",
               batch_ts: str | None = None) -> dict:
    """Upsert records (one JSON object or an array of objects per input file)
    into ``collection``; only changed rows get a new ``updated_at``."""
    return put_records(spark, root, collection, paths, id_field, batch_ts)[0]


def put_records(spark: SparkSession, root: str, collection: str, paths, id_field: str = "id",
                batch_ts: str | None = None) -> tuple[dict, DataFrame]:
    """As ``record_put``, with the ids of the input's records.

    New records are appended, changed ones written as an update: two commits, each
    whole; after a failure between them the same call does what is left.
    """
    from keepsake.sources import records as R
    from keepsake.sources.exports import read_records

    store = _record_store(spark, root)
    current = store.read()
    lines = read_records(spark, paths)
    incoming = written(R.parse_record_lines(lines, collection, id_field, ("file_ord", "path", "pos"), require=True))
    if current is None:
        current = incoming.limit(0).withColumn("updated_at", F.lit(None).cast("string"))
    current = current.select("collection", "id", "data", "updated_at")
    _, dirty = R.upsert_records(current, incoming, batch_ts or batch_time())
    known = current.select("collection", "id").join(incoming.select("collection", "id"), R.RECORD_KEY, "left_semi")
    dirty = written(dirty.join(known.withColumn("known", F.lit(True)), R.RECORD_KEY, "left"))
    counts = dirty.agg(F.count("known").alias("changed"), F.count_if(F.col("known").isNull()).alias("new")).first()
    if counts.new:
        store.append(dirty.where("known is null").drop("known"))
    if counts.changed:
        store.update(dirty.where("known").drop("known"))
    return {"stored": counts.new + counts.changed, "version": store.latest_version()}, incoming.select("id")


def copy_job(spark: SparkSession, source: str, root: str, collection: str, id_field: str = "id",
             backend: str = "ndjson", batch_ts: str | None = None) -> dict:
    """Copy a collection of another backend (a folder of NDJSON files by default) into the store."""
    from keepsake.sources import records as R

    place = {"data_dir": source} if backend == "ndjson" else {"path": source} if backend == "parquet" else {"url": source}
    rows = R.require_ids(R.open_collection(spark, collection, backend, id_field=id_field, **place), id_field)
    store = _record_store(spark, root)
    current = store.read()
    rows = written(rows.select("collection", "id", "data"))
    if current is None:
        new = rows.withColumn("updated_at", F.lit(batch_ts or batch_time()))
    else:
        _, new = R.upsert_records(current, rows, batch_ts or batch_time())
    new = written(new)
    n = new.count()
    return {"copied": n, "version": store.update(new) if n else store.latest_version()}


def fold_job(spark: SparkSession, root: str, records: bool = False) -> dict:
    """Rewrite a store of posts (or of records) as one segment."""
    store = _record_store(spark, root) if records else SnapshotStore(spark, root)
    return {"version": store.fold()}


def record_get(spark: SparkSession, root: str, collection: str, id_: str) -> DataFrame:
    found = _record_store(spark, root).lookup(collection, str(id_))
    return spark.createDataFrame([], "collection string, id string, data string, updated_at string") if found is None else found


def record_list(spark: SparkSession, root: str, collection: str) -> DataFrame:
    recs = _record_store(spark, root).read()
    if recs is None:
        return spark.createDataFrame([], "collection string, id string, data string, updated_at string")
    return recs.where(F.col("collection") == collection).orderBy("id")


_FLAG = {"action": "store_true"}
_PATHS = ("paths", {"nargs": "+"})
_OUT = ("--out", {"required": True})
_FORCE = ("--force", _FLAG)
_COLLECTION = ("--collection", "-c", {"required": True})
_ID_FIELD = ("--id-field", {"default": "id"})


def _show(rows: DataFrame, column: str = "data") -> None:
    for row in rows.select(column).toLocalIterator():
        print(row[0])


def _put(spark: SparkSession, options) -> dict:
    """Stores records; prints the ids of the input, one a line."""
    result, ids = put_records(spark, options.store, options.collection, options.paths, options.id_field)
    _show(ids, "id")
    return result


def _enricher(spark: SparkSession, options):
    """The enricher named on the command line, with its file."""
    if options.enricher == "rules":
        return E.rules_enricher(_categories(options.rules)) if options.rules else E.rules_enricher()
    if not options.answers:
        raise SystemExit(f"--enricher {options.enricher} needs --answers FILE...")
    if options.enricher == "mapping":
        from keepsake.sources.exports import load_mapping

        return E.mapping_enricher(load_mapping(spark, options.answers))
    answers = spark.read.schema("id string, response string").json(options.answers)
    return E.response_enricher(answers)


def _categories(path: str) -> list[tuple[str, list[str], list[str]]]:
    """A rule file: a JSON list of objects with name, keywords and domains."""
    with open(path, encoding="utf-8") as f:
        return [(c["name"], c.get("keywords", []), c.get("domains", [])) for c in json.load(f)]


#: Command -> (what it does with the session and its arguments, the arguments).
COMMANDS = {
    "ingest": (lambda s, o: ingest_job(s, o.store, o.paths), [_PATHS]),
    "enrich": (lambda s, o: enrich_job(s, o.store, _enricher(s, o), limit=o.limit, force=o.force, offline=True),
               [("--limit", {"type": int}), _FORCE,
                ("--enricher", {"default": "rules", "choices": ["rules", "mapping", "responses"]}),
                ("--rules", {"help": "JSON file of categories for the rules enricher"}),
                ("--answers", {"nargs": "+", "help": "enrichment files (mapping) or lines of id and response (responses)"})]),
    "render": (lambda s, o: render_job(s, o.store, o.out), [_OUT]),
    "build": (lambda s, o: build_job(s, o.store, o.out, o.paths, offline=True), [_OUT, ("paths", {"nargs": "*"})]),
    "dump": (lambda s, o: dump_job(s, o.store, o.out, o.chunks, o.force),
             [_OUT, ("--chunks", {"type": int, "default": 1}), _FORCE]),
    "apply": (lambda s, o: apply_job(s, o.store, o.paths, o.force), [_PATHS, _FORCE]),
    "put": (_put, [_COLLECTION, _ID_FIELD, _PATHS]),
    "copy": (lambda s, o: copy_job(s, o.source, o.store, o.collection, o.id_field, o.backend),
             [_COLLECTION, _ID_FIELD, ("--source", {"required": True}), ("--backend", {"default": "ndjson"})]),
    "fold": (lambda s, o: fold_job(s, o.store, o.records), [("--records", _FLAG)]),
    "get": (lambda s, o: _show(record_get(s, o.store, o.collection, o.id)), [_COLLECTION, ("--id", {"required": True})]),
    "list": (lambda s, o: _show(record_list(s, o.store, o.collection)), [_COLLECTION]),
}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="keepsake.jobs", description=__doc__)
    top.add_argument("--store", required=True, help="store root on a shared file system")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        command = commands.add_parser(name)
        for *names, how in arguments:
            command.add_argument(*names, **how)
    options = top.parse_args(argv)
    result = COMMANDS[options.command][0](SparkSession.builder.getOrCreate(), options)
    if result is not None:
        print(json.dumps(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
