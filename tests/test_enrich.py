"""Enrichment runs: backfill, manual tags, error isolation, limits, retry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import post, posts_df
from keepsake.operators import enrich as E

NOW = "2025-01-01T00:00:00+00:00"


def ok_enricher(row):
    return {"summary": "sum " + row["id"], "topic": "T", "tags": ["a", "b"]}


def test_udf_enricher_sets_fields_and_keeps_manual_tags(spark):
    p = posts_df(spark, [post(1, text="x"), post(2, text="y", tags=["keep"], tags_source="manual")])
    out = {r.id: r for r in E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW).collect()}
    assert out["1"].summary == "sum 1" and out["1"].tags == ["a", "b"] and out["1"].tags_source == "auto"
    assert out["2"].tags == ["keep"] and out["2"].tags_source == "manual" and out["2"].topic == "T"
    assert out["1"].enriched and out["1"].enriched_at == NOW and out["1"].enrich_error == ""


def test_one_failure_is_isolated(spark):
    def flaky(row):
        if row["id"] == "2":
            raise ValueError("bad row")
        return ok_enricher(row)

    p = posts_df(spark, [post(1, text="x"), post(2, text="y")])
    res = E.enrich_pending(p, E.udf_enricher(flaky), now=NOW)
    stats = E.enrich_stats(res).first()
    assert (stats.enriched, stats.errors) == (1, 1)
    bad = res.where("id = '2'").first()
    assert bad.enrich_error == "bad row" and not bad.enriched


def test_exception_without_message_uses_class_name(spark):
    def boom(row):
        raise KeyError()

    p = posts_df(spark, [post(1, text="x")])
    assert E.enrich_pending(p, E.udf_enricher(boom), now=NOW).first().enrich_error == "KeyError"


def test_backfill_from_content(spark):
    p = posts_df(spark, [post(1, text="", author_handle=""), post(2, text="", author_handle="mine"),
                         post(3, text="")])
    content = spark.createDataFrame([("1", "fetched", "h1", "N1", "2020", None), ("2", "", "h2", "N2", "", None)],
                                    "id string, text string, author_handle string, author_name string, "
                                    "created_at string, media array<struct<thumb:string,type:string,url:string>>")
    res = {r.id: r for r in E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, content=content).collect()}
    assert res["1"].text == "fetched" and res["1"].author_handle == "h1" and res["1"].created_at == "2020"
    assert res["2"].text == "" and res["2"].author_handle == "mine" and res["2"].enriched
    assert res["3"].enrich_error == "tweet not found" and not res["3"].enriched


def test_backfill_with_fetcher_function(spark):
    def fetcher(id_):
        if id_ == "1":
            return {"text": "fetched", "author_handle": "f", "media": [{"type": "photo", "url": "u"}]}
        if id_ == "2":
            return None
        raise RuntimeError("network down")

    p = posts_df(spark, [post(1, text=""), post(2, text=""), post(3, text="")])
    res = {r.id: r for r in E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, fetcher=fetcher).collect()}
    assert res["1"].text == "fetched" and res["1"].media[0].url == "u" and res["1"].enriched
    assert res["2"].enrich_error == "tweet not found"
    assert res["3"].enrich_error == "network down"


def test_fetching_retries_with_one_client_per_task(spark, scratch):
    """Each id is asked at most three times; results keep their ids whatever call ends first."""
    import os
    import time

    folder = scratch[len("file:"):] if scratch.startswith("file:") else scratch
    os.makedirs(folder)

    def client():
        with open(f"{folder}/clients", "a") as f:
            f.write("x")
        return {"calls": 0}

    def flaky(id_, shared):
        with open(f"{folder}/calls-{id_}", "a") as f:
            f.write("x")
        time.sleep(0.002 * (int(id_) % 5))
        asked = os.path.getsize(f"{folder}/calls-{id_}")
        if int(id_) % 4 == 0 and asked < 3 or int(id_) % 7 == 0:
            raise ConnectionError(f"try {asked}")
        return None if int(id_) % 11 == 0 else {"text": f"text {id_}"}

    p = posts_df(spark, [post(k, text="") for k in range(1, 40)]).coalesce(2)
    marked = E.mark_targets(p).where("_target").withColumn("_fetch_error", F.lit(None).cast("string"))
    got = {r.id: r for r in E.backfill_with_fetcher(marked, flaky, setup=client, sleep=lambda s: None).collect()}
    for k in range(1, 40):
        calls = os.path.getsize(f"{folder}/calls-{k}")
        if k % 7 == 0:
            assert calls == 3 and got[str(k)]._fetch_error == "try 3"
        else:
            assert calls == (3 if k % 4 == 0 else 1)
            assert got[str(k)]._fetch_error == ("tweet not found" if k % 11 == 0 else None)
            assert got[str(k)].text == ("" if k % 11 == 0 else f"text {k}")
    assert os.path.getsize(f"{folder}/clients") <= 2


def test_limit_and_negative_limit(spark):
    p = posts_df(spark, [post(i, text="x") for i in (3, 1, 2)])
    res = E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, limit=2)
    assert sorted(r.id for r in res.where("enriched").collect()) == ["1", "2"]
    assert E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, limit=0).where("enriched").count() == 0
    with pytest.raises(ValueError):
        E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, limit=-1)


def test_second_run_is_noop(spark):
    p = posts_df(spark, [post(1, text="x"), post(2, text="")])
    first = E.drop_status(E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, offline=True))
    stats = E.enrich_stats(E.enrich_pending(first, E.udf_enricher(ok_enricher), now=NOW, offline=True)).first()
    assert (stats.enriched, stats.errors) == (0, 0)


def test_mapping_enricher_missing_ids_error(spark):
    p = posts_df(spark, [post(1, text="x"), post(2, text="y")])
    m = spark.createDataFrame([("1", " S ", " T ", [" Tag ", " ", "Two"])],
                              "id string, summary string, topic string, tags array<string>")
    res = {r.id: r for r in E.enrich_pending(p, E.mapping_enricher(m), now=NOW, offline=True).collect()}
    assert (res["1"].summary, res["1"].topic, res["1"].tags) == ("S", "T", ["tag", "two"])
    assert res["2"].enrich_error == E.NO_MAPPING
    skip = E.enrich_pending(p, E.mapping_enricher(m, skip_missing=True), now=NOW, offline=True)
    assert skip.where("id = '2'").first().enrich_error == ""


def test_force_reenriches_all(spark):
    p = posts_df(spark, [post(1, text="x", enriched=True, summary="old")])
    res = E.enrich_pending(p, E.udf_enricher(ok_enricher), now=NOW, force=True).first()
    assert res.summary == "sum 1"


def test_retry_backoff():
    sleeps, calls = [], []

    def flaky():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(RuntimeError):
        E.retry(flaky, retries=3, sleep=sleeps.append)()
    assert sleeps == [1, 2] and len(calls) == 3
    assert E.retry(lambda: None, sleep=sleeps.append)() is None
    _ = F
