"""Capture formats: flat export, rich capture, URL list, autodetect, maps."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from keepsake.sources import exports as X

SAMPLE = [
    {"id": "1001", "url": "https://x.com/alice/status/1001", "author_handle": "alice", "author_name": "Alice",
     "text": "hello", "created_at": "2024-01-01T00:00:00Z", "media": [{"type": "photo", "url": "https://m/1.jpg"}]},
    {"id": "1002", "url": "https://x.com/bob/status/1002", "author_handle": "bob", "author_name": "Bob",
     "text": "world", "created_at": "2024-01-02T00:00:00Z", "media": []},
    {"url": "https://x.com/c/status/1003", "text": "no id"},
    {"id": 1004, "url": "", "text": "numeric id, no url"},
    {"id": "", "url": "https://example.com/none", "text": "dropped"},
]


def _docs(spark, *values):
    rows = [(i, f"f{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file_ord long, path string, value string")


def _posts(spark, *values, fmt=None):
    return X.posts_from_documents(_docs(spark, *values), fmt).orderBy("file_ord", "pos").collect()


def test_flat_export_list(spark):
    rows = _posts(spark, SAMPLE, fmt=X.JSON_EXPORT)
    assert [r.id for r in rows] == ["1001", "1002", "1003", "1004"]
    assert rows[3].url == "https://x.com/i/status/1004"
    assert rows[0].media[0].url == "https://m/1.jpg" and rows[0].source == "json-export"


@pytest.mark.parametrize("key", ["bookmarks", "data"])
def test_wrapped_exports(spark, key):
    rows = _posts(spark, {key: SAMPLE[:2]}, fmt=X.JSON_EXPORT)
    assert [r.id for r in rows] == ["1001", "1002"]


def test_export_skips_junk_items(spark):
    rows = _posts(spark, [SAMPLE[0], "junk", 42, None, SAMPLE[1]], fmt=X.JSON_EXPORT)
    assert [r.id for r in rows] == ["1001", "1002"]


def test_export_top_level_string_is_error(spark):
    with pytest.raises(Exception, match="unsupported export format"):
        _posts(spark, json.dumps("just a string"), fmt=X.JSON_EXPORT)


def test_rich_capture_metrics_coercion(spark):
    item = {"id": "9", "url": "https://x.com/a/status/9", "author": {"handle": "a", "name": "A"},
            "metrics": {"likes": 5, "views": "12", "evil": "<script>x</script>", "ratio": 2.9, "flag": True},
            "hashtags": ["h"], "lang": None, "created_at": None}
    rows = _posts(spark, {"bookmarks": [item]})
    r = rows[0]
    assert r.source == "extension" and r.author_handle == "a"
    assert dict(r.metrics) == {"likes": 5, "views": 12, "ratio": 2, "flag": 1}
    assert r.lang == "" and r.created_at is None and r.hashtags == ["h"]


def test_rich_capture_non_object_author_is_empty(spark):
    rows = _posts(spark, [{"id": "1", "url": "u", "author": "x", "metrics": {}}])
    assert rows[0].author_handle == ""


def test_url_list_text_and_json(spark):
    text = "  https://x.com/a/status/11 \n\nhttps://x.com/b/status/12 https://nope.example/x\r\n"
    rows = _posts(spark, text, ["https://x.com/c/status/13", "bad"])
    assert [(r.id, r.url, r.source) for r in rows] == [
        ("11", "https://x.com/a/status/11", "url-list"), ("12", "https://x.com/b/status/12", "url-list"),
        ("13", "https://x.com/c/status/13", "url-list")]


def test_autodetect(spark):
    docs = _docs(spark, SAMPLE, {"bookmarks": [{"id": "1", "metrics": {}}]}, ["https://x.com/a/status/1"],
                 "not json at all", [])
    got = [r.f for r in docs.orderBy("file_ord").select(X.detect_format(F.try_parse_json("value")).alias("f"))
           .collect()]
    assert got == ["json-export", "extension", "url-list", "url-list", "url-list"]


def test_read_captures_from_files(spark, scratch):
    os.makedirs(scratch.replace("file:", ""), exist_ok=True)
    base = scratch.replace("file:", "")
    with open(base + "/a.json", "w", encoding="utf-8") as f:
        json.dump({"bookmarks": SAMPLE[:2]}, f)
    with open(base + "/b.txt", "w", encoding="utf-8") as f:
        f.write("https://x.com/z/status/77\n")
    rows = X.read_captures(spark, [base + "/a.json", base + "/b.txt"]).orderBy("file_ord", "pos").collect()
    assert [(r.id, r.format) for r in rows] == [("1001", "json-export"), ("1002", "json-export"), ("77", "url-list")]


def test_mapping_files_later_wins(spark):
    a = {"1": {"summary": " S1 ", "topic": "t", "tags": ["A", " ", "b"]}, "2": {"summary": "s2"}, "x": 5}
    b = [{"id": "2", "summary": "new"}, {"id": "", "summary": "ignored"}, {"id": 0}, 7]
    ent = X.mapping_entries(_docs(spark, a, b))
    from keepsake.operators.merge import dedupe_last
    m = {r.id: r for r in dedupe_last(ent, "id", list(X.MAP_ORDER)).collect()}
    assert set(m) == {"1", "2"} and m["2"].summary == "new" and m["1"].tags == ["A", " ", "b"]


def test_record_input_rejects_non_objects(spark):
    df = spark.createDataFrame([('[{"id": 1}, 2]',)], "value string")
    with pytest.raises(Exception, match="must be a JSON object"):
        df.select(F.explode(X.record_items(F.col("value")))).collect()
    ok = spark.createDataFrame([('{"id": 1}',)], "value string").select(F.explode(X.record_items(F.col("value"))))
    assert ok.count() == 1


def test_bookmark_response_filter(spark):
    log = spark.createDataFrame([("https://x.com/i/api/graphql/abc/Bookmarks?v=1", '{"a":1}'),
                                 ("https://x.com/i/api/graphql/abc/BookmarksX", '{"a":1}'),
                                 ("https://x.com/i/api/graphql/abc/Bookmarks", "<html>"),
                                 ("https://x.com/i/api/graphql/abc/HomeTimeline", "{}")], "url string, body string")
    assert X.bookmark_responses(log).count() == 1
