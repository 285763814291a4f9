"""Search through the trigram index against the plain predicate."""

from __future__ import annotations

import random

from conftest import post, posts_df
from keepsake.operators import search as S
from keepsake.operators import search_index as SI

WORDS = ["alpha", "beta", "Gamma", "détente", "日本語", "🙂🙂", "ab", "x", "alphabet", "new york"]


def test_index_equals_the_predicate(spark, scratch):
    rnd = random.Random(3)
    posts = posts_df(spark, [post(k, text=" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(5))), tags=[rnd.choice(WORDS)])
                             for k in range(120)])
    SI.write_index(posts, scratch + "/ix", buckets=5)
    for q in (None, "", "  ", "alpha", "ALPHABET beta", "lph eta", "ab", "x alpha", "日本語", "🙂🙂 x", "missing words", "détente new",
              "a_b", "\n"):
        for tag in (None, "x"):
            got = sorted(r.id for r in SI.search(spark, scratch + "/ix", q, tag).collect())
            assert got == sorted(r.id for r in S.search(posts, q, tag).collect()), (q, tag)
    assert SI.search(spark, scratch + "/ix", "beta").columns == posts.columns


def test_a_rare_query_reads_few_posts(spark, scratch):
    posts = posts_df(spark, [post(k, text=f"common words {'needle' if k == 77 else ''}") for k in range(400)])
    SI.write_index(posts, scratch + "/ix", buckets=40)
    found = SI.search(spark, scratch + "/ix", "needle")
    assert [r.id for r in found.collect()] == ["77"]
    assert SI.candidates(spark, scratch + "/ix", "needle").select("bucket").distinct().count() == 1
    scans = [p for p in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [") if "/ix/posts" in p or "bucket" in p]
    assert any(p.startswith("isnotnull(bucket") or "(bucket#" in p.split("]")[0] for p in scans[1:])  # one directory is read
    plan = SI.candidates(spark, scratch + "/ix", "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_postings_are_rows_of_a_gram_not_of_a_post(spark, scratch):
    rows = [post(k, text="the same words \U0001d11e\u00e9\u0130", tags=[]) for k in range(300)] + [post(7, text="ab"), post(7, text="words of seven")]
    SI.write_index(posts_df(spark, rows), scratch + "/ix", buckets=3)
    held = spark.read.parquet(scratch + "/ix/postings").where("gram = 'sam'").selectExpr("size(numbers) AS n").collect()
    assert sum(r.n for r in held) == 300 > 10 * len(held)
    assert sorted(r.text for r in SI.search(spark, scratch + "/ix", "seven").collect()) == ["words of seven"]
    assert SI.search(spark, scratch + "/ix", "words \U0001d11e\u00e9").count() == 300
