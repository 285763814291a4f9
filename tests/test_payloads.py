"""Raw payload extraction and normalisation."""

from __future__ import annotations

import json

import pytest

from keepsake.operators.normalize import capture_to_posts, normalize_payloads, normalize_results, write_capture
from keepsake.sources.payloads import expand_results, extract_results
from payload_cases import result, timeline


def _norm(spark, *payloads):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "file_ord long, value string")
    res = extract_results(df).select("file_ord", "pos", "result")
    return {r.id: r for r in normalize_payloads(res, ["file_ord", "pos"], "noon").collect()}


NESTED = """
{"zeta": {"tweet_results": {"result": {"rest_id": "1"}}},
 "alfa": [[{"tweet_results": {"result": {"rest_id": "2", "quoted": {"tweet_results": {"result": {"rest_id": "3"}}}}}}],
          {"tweet_results": {"result": "text"}}, {"tweet_results": 5}, "tweet_results"],
 "beta": {"x": 1, "tweet_results": {"result": {"rest_id": "4"}}}}
"""


def test_results_at_any_depth_in_document_order(spark):
    df = spark.createDataFrame([(NESTED,)], "value string")
    rows = extract_results(df).orderBy("pos").collect()
    assert [json.loads(r.result)["rest_id"] for r in rows] == ["1", "2", "3", "4"]


@pytest.mark.parametrize("text", ["{broken", "", "17", '"tweet_results"', "[]"])
def test_payloads_without_results(spark, text):
    assert extract_results(spark.createDataFrame([(text,)], "value string")).count() == 0


def _tree(rng, depth=0):
    kind = rng.choice("sndlooh") if depth < 6 else "s"
    if kind == "s":
        return rng.choice(["x", '{"tweet_results": {"result": {"rest_id": "no"}}}', "tweet_results", "", "é[{"])
    if kind in "nd":
        return rng.choice([1, 2.5, None, True])
    if kind == "l":
        return [_tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    out = {k: _tree(rng, depth + 1) for k in rng.sample(["z", "b", "a'c", "m.n", "tweet", "ü"], rng.randrange(1, 5))}
    if kind == "h":
        held = {"result": rng.choice([_tree(rng, depth + 1), {"rest_id": str(rng.randrange(10**6)), "quoted": _tree(rng, depth + 1)}])}
        out = dict(rng.sample([*out.items(), ("tweet_results", rng.choice([held, held, held, 7, []]))], len(out) + 1))
    return out


def test_native_expansion_equals_the_walk(spark):
    import random

    rng = random.Random(2)
    texts = [json.dumps(_tree(rng), ensure_ascii=k % 2 == 0) for k in range(250)] + [NESTED, "{broken", None, "17", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, value string")

    def rows(found):
        return sorted((r.n, r.pos, json.dumps(json.loads(r.result))) for r in found.collect())
    native = expand_results(df)
    assert rows(native) == rows(extract_results(df)) and len(rows(native)) > 100
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keys_and_strings_with_escapes(spark):
    held = '{"result": {"rest_id": "%s"}}'
    texts = ['{"a": {"tweet\\u005fresults": %s}, "b": "{\\"tweet_results\\": {\\"result\\": {}}}"}' % (held % 1),
             '[{"tweet_results": %s}, "[{\\u0022tweet_results\\u0022: {}}]", {"note_tweet_results": %s}]' % (held % 2, held % 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    got = [[(r.n, r.pos, json.loads(r.result)["rest_id"]) for r in f(df).orderBy("n", "pos").collect()]
           for f in (expand_results, extract_results)]
    assert got[0] == got[1] == [(0, 0, "1"), (1, 0, "2")]


def test_a_level_parses_a_container_once(spark, monkeypatch):
    from keepsake.sources import payloads as P

    plans = []
    monkeypatch.setattr(P, "written", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df.localCheckpoint())
    assert expand_results(spark.createDataFrame([(NESTED,)], "value string")).count() == 4
    assert not any("parse_json" in p.split("transform(")[-1] for p in plans if "inline(" in p)


def test_payloads_are_written_once_for_many_levels(spark, monkeypatch):
    from keepsake.sources import payloads as P

    held = '{"x": {"tweet_results": {"result": {"rest_id": "%s"}}}}'
    texts = ['{"a": [' * depth + held % k + ', ' + held % (k + 3) + ']}' * depth for k, depth in enumerate((4, 0, 2))]
    sizes, really = [], P.written
    monkeypatch.setattr(P, "written", lambda df: sizes.append(None) or really(df))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if k != 1], "n int, value string")
    flat = expand_results(df)
    assert len(sizes) == 1 and "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "LEVELS", 6)  # deeper ones take another step
    again = expand_results(df)
    assert len(sizes) == 3
    want = [(r.n, r.pos, json.loads(r.result)["rest_id"], r.value) for r in extract_results(df).orderBy("n", "pos").collect()]
    for found in (flat, again):
        assert [(r.n, r.pos, json.loads(r.result)["rest_id"], r.value) for r in found.orderBy("n", "pos").collect()] == want
    assert len(want) == 4


def test_payloads_go_to_python_in_small_batches(spark):
    plan = extract_results(spark.createDataFrame([(NESTED,)], "value string"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_fields_of_a_result(spark):
    r = _norm(spark, timeline(result(31, text="boa tarde", handle="rui")))["31"]
    assert (r.url, r.text, r.author.name) == ("https://x.com/rui/status/31", "boa tarde", "Dona rui")
    assert r.created_at == "2020-03-14T09:26:53+00:00" and r.lang == "pt"
    assert r.hashtags == ["cais"] and r.links == ["https://rio.example/um", "https://t.co/bb"] and r.mentions == ["porto"]
    assert (r.metrics["likes"], r.metrics["views"], r.metrics["retweets"], r.metrics["replies"]) == (11, 1618, 2, 0)
    assert r.captured_at == "noon" and r.source == "x-bookmarks" and r.is_quote is False


def test_long_text_inside_a_wrapper(spark):
    long = result(32, text="começo") | {"note_tweet": {"note_tweet_results": {"result": {"text": "do começo ao fim"}}}}
    r = _norm(spark, timeline({"__typename": "TweetWithVisibilityResults", "tweet": long}))["32"]
    assert r.text == "do começo ao fim" and r.hashtags == ["cais"]


MEDIA = """
[{"type": "photo", "media_url_https": "https://foto.example/1.png"},
 {"type": "animated_gif", "media_url_https": "https://foto.example/2.png", "video_info": {"variants": []}},
 {"type": "video", "media_url_https": "https://foto.example/3.png", "video_info": {"variants": [
    {"content_type": "application/x-mpegURL", "url": "lista"}, {"content_type": "video/mp4", "bitrate": 256, "url": "fraco"},
    {"content_type": "video/mp4", "bitrate": 2048, "url": "forte"}, {"content_type": "video/mp4", "bitrate": 2048, "url": "igual"}]}}]
"""


def test_media_take_their_best_variant(spark):
    r = _norm(spark, timeline(result(33, extended_entities={"media": json.loads(MEDIA)})))["33"]
    assert [(m.type, m.url) for m in r.media] == [("photo", "https://foto.example/1.png"),
                                                  ("animated_gif", "https://foto.example/2.png"), ("video", "forte")]


def test_first_of_an_id_wins_and_empty_ids_go(spark):
    got = _norm(spark, timeline(result(34, text="antes"), result(""), result(34, text="depois")),
                timeline(result(34, text="outra página")))
    assert {k: r.text for k, r in got.items()} == {"34": "antes"}


def test_mail_style_date_keeps_its_offset(spark):
    got = _norm(spark, timeline(result(35, created_at="Mon, 06 Jul 2020 23:05:09 -0300")))
    assert got["35"].created_at == "2020-07-06T23:05:09-03:00"


def test_capture_to_posts(spark):
    df = spark.createDataFrame([(json.dumps(result(36, handle="ana")),)], "result string")
    p = capture_to_posts(normalize_results(df)).first()
    assert p.author_handle == "ana" and p.source == "extension" and p.metrics["views"] == 1618


def test_written_capture_is_in_export_order(spark, scratch):
    from pyspark.sql import functions as F

    dates = ["Wed Apr 01 10:00:00 +0000 2020", "Fri May 01 10:00:00 +0000 2020", "never", "Fri May 01 10:00:00 +0000 2020"]
    payload = json.dumps(timeline(*(result(40 + k, created_at=d) for k, d in enumerate(dates))))
    df = spark.createDataFrame([(0, payload)], "file_ord long, value string")
    caps = normalize_payloads(extract_results(df).select("file_ord", "pos", "result"), ["file_ord", "pos"])
    write_capture(caps, ["file_ord", "pos"], scratch + "/capture")
    lines = spark.read.text(scratch + "/capture").select("value", F.col("_metadata.file_path").alias("f"),
                                                         F.monotonically_increasing_id().alias("k")).orderBy("f", "k").collect()
    assert [json.loads(r.value)["id"] for r in lines] == ["41", "43", "40", "42"]
