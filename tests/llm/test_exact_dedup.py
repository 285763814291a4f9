import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from keepsake.llm import exact_dedup
from llm_helpers import docs  # noqa: F401


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


ROWS = [(1, "Same TEXT"), (2, "same text"), (9, "sAME tEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200000),
        (8, "X" * 200000), (10, " same text"), (11, "Same text\n"), (None, "alone"), (None, "same text")]


def test_groups_against_a_dictionary(spark, docs):  # noqa: F811
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[low(t)].append(i)
    got = exact_dedup.exact_groups(docs(ROWS).withColumn("digest", F.lit(0)).withColumn("run", F.lit(1))).collect()
    assert len(got) == len(ROWS)
    text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = text[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
    assert exact_dedup.exact_groups(docs([])).count() == 0


def test_repeated_rows_and_many_runs(spark, docs):  # noqa: F811
    rows = [(i % 50, f"text {i % 7}") for i in range(400)]
    df = docs(rows).repartition(40)
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == 400
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(kept) == 7 and set(kept.values()) == {1}
    out = exact_dedup.drop_copies(df.withColumn("row", F.lit("r"))).collect()
    best = defaultdict(int)
    for i, t in rows:
        best[t] = max(best[t], i)
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, t) for t, i in best.items())
    assert out[0]["row"] == "r"


def test_drop_copies_keeps_the_largest_id(spark, docs):  # noqa: F811
    out = exact_dedup.drop_copies(docs(ROWS))
    assert out.columns == docs(ROWS).columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 4, 5, 6, 8, 9, 10, 11]
    assert exact_dedup.drop_copies(docs([])).count() == 0
