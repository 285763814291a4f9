"""Catalog, listing payload and display helpers."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from conftest import post, posts_df
from keepsake.functions.core import format_metric, html_escape, metrics_line
from keepsake.operators import catalog as cat
from keepsake.operators import search as S


def test_multi_tag_listed_twice_and_untagged(spark):
    p = posts_df(spark, [post(1, tags=["a", "b"]), post(2), post(3, tags=["a"])])
    got = sorted((r.tag, r.id) for r in cat.catalog_entries(p).collect())
    assert got == [("a", "1"), ("a", "3"), ("b", "1"), ("untagged", "2")]
    assert cat.catalog_header(p).first().n_posts == 3


def test_catalog_line_format(spark):
    p = posts_df(spark, [post(1, text=" line1\nline2 ", author_handle="ann", tags=["t"]),
                         post(2, url="javascript:alert(1)", summary="S", tags=["t"])])
    lines = {r.id: r.line for r in cat.catalog_entries(p).collect()}
    assert lines["1"] == "- @ann — [line1 line2](https://x.com/u/status/1) `#1`"
    assert lines["2"] == "- [S](#) `#2`"


def test_empty_catalog(spark):
    p = posts_df(spark, [])
    assert cat.catalog_entries(p).count() == 0 and cat.catalog_header(p).first().n_posts == 0


def test_public_payload_escapes_and_whitelists(spark):
    p = posts_df(spark, [post(1, text="</script><b>", enrich_error="secret", url="JAVASCRIPT:x")])
    line = cat.public_payload_lines(p).first().json
    assert "<" not in line and "\\u003c/script>" in line
    obj = json.loads(line)
    assert set(obj) == set(cat.PUBLIC_FIELDS) and obj["url"] == "#" and obj["text"] == "</script><b>"


def test_tag_facet_and_search(spark):
    p = posts_df(spark, [post(1, text="Hello World", tags=["b", "a"]), post(2, text="hello", tags=["a"]), post(3)])
    assert sorted(r.tag for r in cat.tag_facet(p).collect()) == ["a", "b"]
    assert sorted(r.id for r in S.search(p, q="  WORLD hello ").collect()) == ["1"]
    assert S.search(p, q="   ").count() == 3
    assert sorted(r.id for r in S.search(p, tag="a", q="hello").collect()) == ["1", "2"]
    c = S.search_counts(p, q="hello").first()
    assert (c.shown, c.total) == (2, 3)


def js_fmt(n: int) -> str:
    """JavaScript ``fmt``: toFixed rounds the exact binary value half-up."""
    if n < 1000:
        return str(n)
    digits = 0 if n >= 10000 else 1
    exact = Decimal(n / 1000)
    return str(exact.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)) + "k"


def test_format_metric_matches_javascript(spark):
    df = spark.range(0, 30001).select(F.col("id").alias("n"), format_metric(F.col("id")).alias("f"))
    got = {r.n: r.f for r in df.collect()}
    bad = [n for n in range(0, 30001) if got[n] != js_fmt(n)]
    assert not bad, bad[:10]


def test_metrics_line_and_escape(spark):
    df = spark.createDataFrame([({"likes": 1500, "views": 0, "bookmarks": 3},)], "m map<string,bigint>")
    assert df.select(metrics_line("m")).first()[0] == "♥ 1.5k · ⌂ 3"
    e = spark.createDataFrame([("<a href='x'>&\"",)], "s string").select(html_escape("s")).first()[0]
    assert e == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
