import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from keepsake.llm import quality
from llm_helpers import docs  # noqa: F401

VOCABULARY = [a + b for a in ("lor", "mip", "dan", "ket", "sul", "ver", "pon") for b in ("a", "em", "ist", "or", "und", "e")]


def text(i, n=100):
    rng = random.Random(i)
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[k:k + 12]) for k in range(0, n, 12))


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    rep = {p + d for ps in at.values() if len(ps) > 1 for p in ps for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


EDGE = [None, "", " \n\t ", "a", "a b c a b c", "x x x x x x", "a b c\nd\na b c\n \n", "é𝄞 ü # <>\n\n#", "    b",
        "w " * 60000, "a b c d a b c e b c d"]


def test_counts_against_plain_python(docs):
    rows = [(i, t) for i, t in enumerate(EDGE + [text(i) for i in range(5)])]
    got = quality.quality_report(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_adaptive_limits_reject_outliers_only(docs):
    rows = [(i, text(i), "en", "a" if i % 2 else "b") for i in range(140)]
    rows += [(900, re.sub(r" ", " ### ", text(9)), "en", "a"), (901, "averylongword" * 3 + text(3).replace(" ", "ordinarily "), "en", "b"),
             (902, text(7), None, None), (902, text(7), None, None)]
    df = docs(rows).withColumn("kept", F.lit("x")).withColumn("_w", F.lit(1)).withColumn("row", F.lit(2))
    report = Counter((r["doc_id"], r["kept"]) for r in quality.quality_report(df).collect())
    assert report[(900, False)] == 1 and report[(901, False)] == 1 and report[(902, True)] == 2
    assert all(k for (i, k) in report if i < 900)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: n for (i, k), n in report.items() if k})


def test_empty_table(docs):
    assert quality.quality_report(docs([])).count() == 0
    assert quality.keep_good(docs([])).count() == 0


def test_buckets_are_close_from_below(spark):
    got = spark.range(0, 100000, 7).select(F.col("id").alias("v"), quality.bucket("id").alias("b")).collect()
    assert all(r["b"] <= r["v"] < r["b"] + max(1, r["b"] / 32) for r in got)
