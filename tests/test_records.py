"""Generic record collections."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from keepsake.sources import records as R


def _lines(spark, objs, path="c"):
    rows = [(path, 0, i, json.dumps(o)) for i, o in enumerate(objs)]
    return spark.createDataFrame(rows, "path string, block long, line_no long, value string")


def test_replace_by_id_last_wins(spark):
    r = R.parse_record_lines(_lines(spark, [{"id": "a", "v": 1}, {"id": "a", "v": 2}, {"id": "b", "v": 3}]), "c")
    got = {x.id: json.loads(x.data)["v"] for x in r.collect()}
    assert got == {"a": 2, "b": 3}


def test_custom_id_field_and_numeric_ids(spark):
    r = R.parse_record_lines(_lines(spark, [{"slug": "x", "score": 1}, {"slug": 7}, {"other": 1}]), "c", "slug")
    assert sorted(x.id for x in r.collect()) == ["7", "x"]


def test_unicode_separators_stay_in_record(spark):
    r = R.parse_record_lines(_lines(spark, [{"id": "a", "t": "x y\u0085z"}]), "c")
    assert json.loads(r.first().data)["t"] == "x y\u0085z"


def test_collection_isolation(spark):
    a = R.parse_record_lines(_lines(spark, [{"id": "1", "v": "a"}]), "A")
    b = R.parse_record_lines(_lines(spark, [{"id": "1", "v": "b"}]), "B")
    both = a.unionByName(b)
    assert both.count() == 2
    merged, dirty = R.upsert_records(both, b.withColumn("data", F.lit('{"id":"1","v":"c"}')), "t")
    got = {(x.collection, x.id): json.loads(x.data)["v"] for x in merged.collect()}
    assert got == {("A", "1"): "a", ("B", "1"): "c"} and dirty.count() == 1


def test_clean_upsert_is_noop(spark):
    cur = R.parse_record_lines(_lines(spark, [{"id": "1", "v": 1}, {"id": "2", "v": 2}]), "c")
    _, dirty = R.upsert_records(cur, cur, "t")
    assert dirty.count() == 0


def test_missing_id_on_write_fails(spark):
    bad = spark.createDataFrame([("c", "", "{}")], "collection string, id string, data string")
    with pytest.raises(Exception, match="missing required id"):
        R.require_ids(bad).collect()


def test_partitioned_table_reads_one_collection(spark, scratch):
    r = R.parse_record_lines(_lines(spark, [{"id": "1"}, {"id": "2"}]), F.lit("A")).unionByName(
        R.parse_record_lines(_lines(spark, [{"id": "3"}]), F.lit("B")))
    R.write_collections(r.withColumn("updated_at", F.lit("t")), scratch + "/t")
    one = R.open_collection(spark, "A", backend="parquet", path=scratch + "/t")
    assert sorted(x.id for x in one.collect()) == ["1", "2"]


def test_unknown_backend(spark):
    with pytest.raises(ValueError, match="unknown backend"):
        R.open_collection(spark, "x", backend="nope")
