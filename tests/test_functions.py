"""Row functions compared with plain-Python semantics."""

from __future__ import annotations

import json
import re
from email.utils import parsedate_to_datetime
from urllib.parse import urlparse

from pyspark.sql import functions as F

from keepsake.functions import core as C
from keepsake.functions.json import build_prompt, parse_response


def _col(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_extract_id(spark):
    vals = ["https://x.com/a/status/123?s=1", "https://x.com/a/status/12/status/34", "nope", None, "/status/"]
    want = [(re.search(r"/status/(\d+)", v or "") or [None, ""])[1] for v in vals]
    assert _col(spark, vals, C.extract_id) == want


def test_safe_url(spark):
    vals = ["https://a", "HTTP://b", "javascript:x", "", None, " http://c"]
    want = [v if (v or "").lower().startswith(("http://", "https://")) else "#" for v in vals]
    assert _col(spark, vals, C.safe_url) == want


def test_link_hosts_match_urlparse(spark):
    links = ["https://www.GitHub.com/x", "http://user:pw@Host.example.org:8080/p", "//cdn.example.net/x",
             "ftp://files.example.com", "example.com/no-scheme", "https://www.www.x.com", "mailto:a@b.c"]
    df = spark.createDataFrame([(links,)], "l array<string>")
    got = df.select(C.link_hosts(F.col("l"))).first()[0]
    want = []
    for u in links:
        h = (urlparse(u).hostname or "").lower()
        if h:
            want.append(h[4:] if h.startswith("www.") else h)
    assert got == want


def test_parse_created_at(spark):
    vals = ["Wed Oct 10 20:19:24 +0000 2018", "Wed, 10 Oct 2018 20:19:24 +0530", "2018-10-10T20:19:24Z",
            "2018-10-10T20:19:24.5+02:00", "2018-10-10", "garbage", ""]
    got = _col(spark, vals, C.parse_created_at)

    def py(v):
        if not v:
            return None
        try:
            return parsedate_to_datetime(v).isoformat()
        except (TypeError, ValueError):
            pass
        from datetime import datetime
        try:
            return datetime.fromisoformat(v.replace("Z", "+00:00")).isoformat()
        except ValueError:
            return None

    assert got == [py(v) for v in vals]


def test_coerce_metrics(spark):
    raw = json.dumps({"a": 1, "b": "10", "c": 3.9, "d": True, "e": "3.7", "f": "<b>", "g": None, "h": [1]})
    df = spark.createDataFrame([(raw,), ("[1,2]",)], "v string")
    got = [dict(r[0]) for r in df.select(C.coerce_metrics(F.parse_json("v"))).collect()]
    assert got == [{"a": 1, "b": 10, "c": 3, "d": 1}, {}]


def test_parse_response(spark):
    vals = ['```json\n{"summary": " S ", "topic": "T", "tags": [" A ", "", "b"]}\n```',
            '{"summary": "x", "tags": "not-a-list"}', "not json", "[1, 2]"]
    rows = _col(spark, vals, parse_response)
    assert (rows[0].summary, rows[0].topic, rows[0].tags, rows[0].error) == ("S", "T", ["a", "b"], None)
    assert rows[1].tags == [] and rows[1].topic == ""
    assert rows[2].error and rows[3].error


def test_build_prompt(spark):
    df = spark.createDataFrame([("h", "N", "u", "t"), ("", "N", "u", "t")], "h string, n string, u string, t string")
    got = [r[0] for r in df.select(build_prompt("h", "n", "u", "t")).collect()]
    assert got == ["Author: @h (N)\nURL: u\nText: t", "URL: u\nText: t"]


def test_falsy_coalesce_and_strip(spark):
    df = spark.createDataFrame([(None, "", "x"), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(C.falsy_coalesce("a", "b", "c")).collect()] == ["x", "a"]
    assert _col(spark, ["  x \n"], C.strip_ws) == ["x"]


def test_dates_do_not_depend_on_session_zone(spark):
    vals = ["Sun Mar 10 02:30:00 +0000 2024", "Sun, 10 Mar 2024 02:30:00 -0500", "2024-03-10T02:30:00"]
    before = _col(spark, vals, C.parse_created_at)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 does not exist locally
        assert _col(spark, vals, C.parse_created_at) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == ["2024-03-10T02:30:00+00:00", "2024-03-10T02:30:00-05:00", "2024-03-10T02:30:00"]


def test_bracketed_hosts(spark):
    from urllib.parse import urlsplit

    urls = ["http://[2001:db8::1]:80/x", "https://u:p@[::1]", "http://[::ffff:1.2.3.4]/", "http://[1:2:3:4:5:6:7:8]?q", "http://[12]/",
            "http://[1:2]/", "http://[::1", "http://[1::2::3]/", "http://[::1]x/", "http://[1:2:3:4:5:6:7::8:9]/", "//[FE80::A]/",
            "http://www.a.b/[x]", "http://a.b/?q=[::1]", "http://[1:2:3:4:5:6:1.2.3.4]/", "http://[g::1]/"]
    rows = spark.createDataFrame([(k, [u]) for k, u in enumerate(urls)], "k int, links array<string>")
    got = {r.k: r.h for r in rows.select("k", C.link_hosts("links").alias("h")).collect()}
    for k, u in enumerate(urls):
        try:
            host = urlsplit(u).hostname or ""
        except ValueError:
            host = ""
        assert got[k] == ([host.removeprefix("www.")] if host else []), u


def test_query_column_splits_at_unicode_blanks(spark):
    from keepsake.operators import search

    qs = ["\u00a0big\u2003cat ", "big\u3000dog", "\u2028", "cat\tbig"]
    rows = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [r[0] for r in rows.select(search.match_text_column(F.col("q"), F.lit("a big black cat"))).collect()]
    want = [all(w in "a big black cat" for w in search.query_tokens(q)) for q in qs]
    assert got == want == [True, False, True, True]
