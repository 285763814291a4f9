"""Streaming ingest (replay safety), global positions and directory writers."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from conftest import post, posts_df
from keepsake.operators import catalog as cat
from keepsake.operators import order
from keepsake.plans.q_misc import write_chunks
from keepsake.streaming import capture as C
from payload_cases import result, timeline


def _write_log(base, name, *payloads):
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, name), "w", encoding="utf-8") as f:
        for p in payloads:
            f.write(json.dumps(p) + "\n")


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_stream_ingest_first_wins_and_replay_safe(spark, scratch):
    src, store = _local(scratch) + "/in", scratch + "/store"
    _write_log(src, "a.ndjson", timeline(result(1, text="one"), result(2, text="two")))
    C.start_capture_ingest(spark, src, store, scratch + "/ck1").awaitTermination()
    _write_log(src, "b.ndjson", timeline(result(2, text="changed"), result(3, text="three")))
    C.start_capture_ingest(spark, src, store, scratch + "/ck1").awaitTermination()
    got = {r.id: r.text for r in spark.read.parquet(store).collect()}
    assert got == {"1": "one", "2": "two", "3": "three"}
    # Replaying everything with a fresh checkpoint adds nothing (the store is the state).
    C.start_capture_ingest(spark, src, store, scratch + "/ck2").awaitTermination()
    assert spark.read.parquet(store).count() == 3


def test_stream_dedupe(spark, scratch):
    src = _local(scratch) + "/in"
    _write_log(src, "a.ndjson", timeline(result(1), result(1), result(2)), timeline(result(2)))
    C.start_stream_dedupe(spark, src, scratch + "/out", scratch + "/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(scratch + "/out").collect()) == ["1", "2"]


def _rows_in_state(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def test_bounded_dedupe_forgets_old_ids_and_drops_late_ones(spark, scratch):
    base = _local(scratch)
    src, day = base + "/in", 86_400

    def arrive(name, at, *ids):
        _write_log(src, name, timeline(*map(result, ids)))
        os.utime(os.path.join(src, name), (at, at))
        q = C.start_stream_dedupe(spark, src, scratch + "/out", scratch + "/ck", within="2 hours", max_files=1)
        q.awaitTermination()
        return _rows_in_state(q)
    start = 1_700_000_000
    arrive("a.ndjson", start, *range(50))
    arrive("b.ndjson", start + 3600, 7, 8, 100)  # copies within two hours
    assert arrive("c.ndjson", start + day, 200, 201) <= 53
    state = arrive("d.ndjson", start + 2 * day, 300, 301)
    assert state <= 4  # ids older than the watermark are forgotten: the state doesn't grow with the stream
    arrive("e.ndjson", start + 60, 7, 400)  # later than the watermark: dropped unseen
    ids = sorted(int(r.id) for r in spark.read.parquet(scratch + "/out").collect())
    assert ids == [*range(50), 100, 200, 201, 300, 301]


def test_enrichment_stream_follows_commits(spark, scratch):
    from keepsake.operators import enrich as E
    from keepsake.sources.snapshot import SnapshotStore
    from keepsake.streaming.enrich import enrich_commits, start_enrichment

    root, calls = scratch + "/store", spark.sparkContext.accumulator(0)

    def tag(row):
        calls.add(1)
        if row["id"] == "3":
            raise ValueError("no")
        return {"summary": "s" + row["id"], "topic": "t", "tags": ["x"]}

    def run(checkpoint="/ck"):
        start_enrichment(spark, root, scratch + checkpoint, E.udf_enricher(tag), now="n1").awaitTermination()
    store = SnapshotStore(spark, root)
    store.commit(posts_df(spark, [post(1, text="a"), post(2, text="b", enriched=True)]))
    store.append(posts_df(spark, [post(3, text="c")]))
    run()
    version = store.latest_version()
    rows = {r.id: r for r in store.read().collect()}
    assert rows["1"].summary == "s1" and rows["2"].summary == "" and rows["3"].enrich_error == "no" and calls.value == 2
    run()  # its own update brings nothing new
    run("/other")  # every commit again, with a fresh checkpoint
    assert store.latest_version() == version and calls.value == 2
    store.append(posts_df(spark, [post(4, text="d")]))
    run()
    assert {r.id: r.summary for r in store.read().collect()} == {"1": "s1", "2": "", "3": "", "4": "s4"} and calls.value == 3
    assert enrich_commits(store._read_log(), store, E.udf_enricher(tag)) is None


def test_global_position_many_partitions(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k")).repartition(13)
    pos = order.global_position(df, ["k"], partitions=9)
    got = sorted((r.k, r.pos) for r in pos.collect())
    assert got == [(i, i) for i in range(2000)]


def test_round_robin_chunks(spark):
    p = posts_df(spark, [post(i) for i in range(10)])
    ch = {r.id: r.chunk for r in order.round_robin_chunks(p, 3).collect()}
    ids = sorted(ch)
    assert all(ch[i] == n % 3 for n, i in enumerate(ids))
    assert set(order.round_robin_chunks(p, 0).select("chunk").distinct().toPandas()["chunk"]) == {0}


def test_write_catalog_and_chunks(spark, scratch):
    p = posts_df(spark, [post(2, tags=["b", "a"]), post(1, tags=["a"]), post(3)])
    cat.write_catalog(p, scratch + "/catalog", partitions=2)
    cat.write_catalog(p, scratch + "/catalog", partitions=2)  # rendering again replaces it
    lines = [r.value for r in spark.read.text(scratch + "/catalog").withColumn("f", F.input_file_name())
             .withColumn("n", F.monotonically_increasing_id()).orderBy("f", "n").collect()]
    assert lines[:3] == [cat.CATALOG_TITLE, "3 bookmarks.", "## a"]
    assert [x for x in lines if x.startswith("## ")] == ["## a", "## b", "## untagged"]
    assert [x[-4:] for x in lines[3:5]] == ["`#1`", "`#2`"] and len(lines) == 9
    write_chunks(order.round_robin_chunks(p.select("id", "url"), 2), scratch + "/chunks")
    assert spark.read.json(scratch + "/chunks").count() == 3
