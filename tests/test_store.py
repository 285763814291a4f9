"""Post store: additive ingest, upsert, pending, NDJSON round trip, snapshots."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from conftest import post, posts_df
from keepsake.operators import enrich as E
from keepsake.operators import merge
from keepsake.schema import POST_FIELDS
from keepsake.sources.ndjson import read_posts, to_json_lines, write_posts
from keepsake.sources.snapshot import SnapshotStore


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_additive_ingest_is_insert_only_and_idempotent(spark):
    store = posts_df(spark, [post(1, text="old", tags=["x"], tags_source="manual")])
    inc = posts_df(spark, [post(1, text="new"), post(2, text="b")]).withColumn("batch", F.lit(0)) \
        .withColumn("pos", F.col("id").cast("int"))
    merged, added = merge.ingest_additive(store, inc, ["batch", "pos"])
    rows = {r.id: r for r in merged.collect()}
    assert added.count() == 1
    assert rows["1"].text == "old" and rows["1"].tags == ["x"] and rows["1"].tags_source == "manual"
    again, added2 = merge.ingest_additive(merged, inc, ["batch", "pos"])
    assert added2.count() == 0 and again.count() == 2


def test_first_occurrence_wins_inside_batch(spark):
    store = posts_df(spark, [])
    inc = posts_df(spark, [post(5, text="second"), post(5, text="first")]) \
        .withColumn("pos", F.when(F.col("text") == "first", 0).otherwise(1)).withColumn("batch", F.lit(0))
    merged, _ = merge.ingest_additive(store, inc, ["batch", "pos"])
    assert [r.text for r in merged.collect()] == ["first"]


def test_upsert_last_wins(spark):
    base = posts_df(spark, [post(1, summary="a"), post(2, summary="b")])
    ch = posts_df(spark, [post(1, summary="x"), post(1, summary="y")]).withColumn(
        "seq", F.when(F.col("summary") == "y", 1).otherwise(0))
    out = {r.id: r.summary for r in merge.upsert(base, ch, order=["seq"]).collect()}
    assert out == {"1": "y", "2": "b"}


def test_pending_excludes_enriched_and_errored(spark):
    p = posts_df(spark, [post(3), post(1, enriched=True), post(2, enrich_error="boom"), post(4)])
    assert _ids(E.pending(p)) == ["3", "4"]


def test_ndjson_round_trip_keeps_unicode_separators(spark, scratch):
    text = "a b c\u0085d\x0be\x0cf"
    p = posts_df(spark, [post(1, text=text), post(2, text="plain")])
    write_posts(p, scratch + "/s")
    back = {r.id: r.text for r in read_posts(spark, scratch + "/s").collect()}
    assert back == {"1": text, "2": "plain"}


def test_ndjson_last_line_wins(spark, scratch):
    write_posts(posts_df(spark, [post(1, text="v1")]), scratch + "/a")
    write_posts(posts_df(spark, [post(1, text="v2")]), scratch + "/b")
    back = read_posts(spark, [scratch + "/a", scratch + "/b"]).collect()
    assert [(r.id, r.text) for r in back] == [("1", "v2")]


def test_json_line_sorted_keys_all_fields(spark):
    line = to_json_lines(posts_df(spark, [post(1, text="é <x>", metrics={"views": 2, "likes": 1})])).first().value
    obj = json.loads(line)
    assert list(obj) == sorted(obj) == sorted(POST_FIELDS)
    assert list(obj["metrics"]) == ["likes", "views"]
    assert obj["text"] == "é <x>" and obj["enriched"] is False and obj["media"] == []


def test_unknown_keys_ignored(spark):
    p = posts_df(spark, [{"id": "1", "url": "u", "nope": 3}])
    assert p.columns == POST_FIELDS


def test_snapshot_store_versions(spark, scratch):
    st = SnapshotStore(spark, scratch + "/snap", buckets=2)
    assert st.latest_version() is None and st.read() is None
    v1 = st.commit(posts_df(spark, [post(1)]))
    v2 = st.commit(posts_df(spark, [post(1), post(2)]))
    assert (v1, v2) == (1, 2)
    assert st.read().count() == 2 and st.read(1).count() == 1


def test_snapshot_commit_replaces_unlogged_leftover(spark, scratch):
    st = SnapshotStore(spark, scratch + "/snap2", buckets=1)
    # a failed commit left v=000001 without a log entry
    posts_df(spark, [post(9)]).write.parquet(scratch + "/snap2/v=000001")
    assert st.latest_version() is None
    assert st.commit(posts_df(spark, [post(1), post(2)])) == 1
    assert _ids(st.read()) == ["1", "2"]


def _files(root):
    folder = root[len("file:"):] if root.startswith("file:") else root
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names
            if f.endswith(".parquet") and "/_" not in d}


def test_updates_leave_stored_files_and_merge_on_read(spark, scratch):
    st = SnapshotStore(spark, scratch + "/mor")
    st.commit(posts_df(spark, [post(k, text="old") for k in range(20)]))
    st.append(posts_df(spark, [post(k, text="old") for k in range(20, 30)]))
    before = _files(scratch + "/mor")
    st.update(posts_df(spark, [post(3, text="one"), post(25, text="one"), post(90, text="new")]))
    st.update(posts_df(spark, [post(3, text="two")]))
    v = st.append(posts_df(spark, [post(91, text="later")]))
    after = _files(scratch + "/mor")
    assert before.items() <= after.items()
    texts = {r.id: r.text for r in st.read().collect()}
    assert len(texts) == 32 and st.read().count() == 32
    assert (texts["3"], texts["25"], texts["90"], texts["91"], texts["4"]) == ("two", "one", "new", "later", "old")
    assert {r.id: r.text for r in st.read(3).collect()}["3"] == "one" and st.read(2).count() == 30
    assert st.fold() == v + 1 and {r.id: r.text for r in st.read().collect()} == texts
    assert st.fold() == v + 1  # one segment: nothing to do
    assert {r.id: r.text for r in st.read(v).collect()} == texts


def test_updates_only_and_partitioned_stores(spark, scratch):
    st = SnapshotStore(spark, scratch + "/recs", partition_by="collection")
    rows = "collection string, id string, data string"
    st.update(spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], rows))
    st.append(spark.createDataFrame([("a", "2", "z"), ("07", "1", "n")], rows))
    st.update(spark.createDataFrame([("a", "1", "x2"), ("07", "1", "n2")], rows))
    st.update(spark.createDataFrame([("07", "2", "alone")], rows))
    got = sorted(tuple(r) for r in st.read().where("id <> '2' or collection <> '07'").select("collection", "id", "data").collect())
    assert [r.data for r in st.lookup("07", "2").collect()] == ["alone"]
    assert got == [("07", "1", "n2"), ("a", "1", "x2"), ("a", "2", "z"), ("b", "1", "y")]


def test_lookups_read_only_segments_that_may_hold_the_key(spark, scratch):
    st = SnapshotStore(spark, scratch + "/keys")
    assert st.lookup("1") is None and st.segments_of(spark.createDataFrame([("1",)], "id string")) == []
    for k in range(8):  # interleaved ids: ranges alone can't tell the segments apart
        st.append(posts_df(spark, [post(n, text=f"s{k}") for n in range(k, 400, 8)]))
    st.update(posts_df(spark, [post(13, text="changed")]))
    asked = spark.createDataFrame([(str(n),) for n in (13, 21, 9999)], "id string")
    assert st.segments_of(asked) == ["v=000006", "v=000009"]  # 13 and 21 came with the sixth commit
    found = st.lookup("13")
    assert [r.text for r in found.collect()] == ["changed"]
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"v=000006", "v=000009"}
    assert st.lookup("9999").count() == 0 and st.lookup("13").columns == st.read().columns
    every = spark.range(0, 900).select(F.col("id").cast("string").alias("id"))
    assert sorted(int(r.id) for r in st.present(every).collect()) == list(range(400))


def test_two_part_keys_are_probed_together(spark, scratch):
    st = SnapshotStore(spark, scratch + "/two", partition_by="collection")
    st.append(spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "collection string, id string, data string"))
    st.append(spark.createDataFrame([("b", "1", "z")], "collection string, id string, data string"))
    assert [r.data for r in st.lookup("b", "1").collect()] == ["z"] and st.lookup("a", "2").count() == 0
    asked = spark.createDataFrame([("a", "1"), ("a", "2")], "collection string, id string")
    assert [tuple(r) for r in st.present(asked).select("collection", "id").collect()] == [("a", "1")]
