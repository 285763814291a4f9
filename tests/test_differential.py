"""Spark vs plain-Python differential tests on random text."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsake.functions.core import extract_id, link_hosts, safe_url
from keepsake.operators import rules as R

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

PIECES = ["/status/", "status", "/", "12", "٣٤", "x", "é", "?", "#", " ", "http://", "HTTPS://", "www.", "@",
          ":80", "[", "]", "Example.COM", "a.b", "ſ", "ı", "İ", " ", "-", "_"]
texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=40)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


@SETTINGS
@given(texts)
def test_extract_id_matches_python(spark, values):
    want = [(re.search(r"/status/(\d+)", v) or [None, ""])[1] for v in values]
    assert _eval(spark, values, extract_id) == want


@SETTINGS
@given(texts)
def test_safe_url_matches_python(spark, values):
    want = [v if v.lower().startswith(("http://", "https://")) else "#" for v in values]
    assert _eval(spark, values, safe_url) == want


def _py_host(u):
    try:
        h = (urlparse(u).hostname or "").lower()
    except ValueError:
        return None
    if not h:
        return None
    return h[4:] if h.startswith("www.") else h


HOST_PIECES = ["http://", "https://", "//", "www.", "Example.COM", "a.b", "user@", ":8080", "/p", "?q", "#f", "x"]
urls = st.lists(st.lists(st.sampled_from(HOST_PIECES), max_size=6).map("".join), min_size=1, max_size=40)


@SETTINGS
@given(urls)
def test_link_hosts_match_urlparse(spark, values):
    df = spark.createDataFrame([(values,)], "l array<string>")
    got = df.select(link_hosts(F.col("l"))).first()[0]
    want = [h for h in (_py_host(u) for u in values) if h]
    assert got == want


WORDS = ["ai", "AI", "rust", "trust", "api", "rapid", "go", "ego", "ſ", "ı", "İ", "é", "x_ai", "ai9", "٣", "-", " "]
sentences = st.lists(st.lists(st.sampled_from(WORDS), max_size=8).map("".join), min_size=1, max_size=30)
PATTERNS = [r"\bai\b", r"rust\b", r"api\b", r"\bgo\b", "ai", "fact.?check"]


@SETTINGS
@given(sentences)
@example(["İai", "ai\u0301", "x\u0301ai", "ai‿x", "½ai"])
def test_keyword_hits_match_python_re(spark, values):
    df = spark.createDataFrame([(i, v.lower()) for i, v in enumerate(values)], "i int, hay string")
    hay = F.col("hay")
    cols = [R.keyword_hit(hay, p, R.has_fold_specials(hay)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]
    rows = df.select("i", "hay", *cols).orderBy("i").collect()
    for r in rows:
        for k, p in enumerate(PATTERNS):
            want = re.search(R.whole_word(p), r.hay, re.I) is not None
            assert r[f"p{k}"] == want, (r.hay, p)
