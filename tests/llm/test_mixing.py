import re
from collections import defaultdict

from keepsake.llm import mixing
from keepsake.llm.queries import QUERIES
from llm_helpers import docs  # noqa: F401


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes):
    """Targets by resharing the excess until no source is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(rows, got, slack=40):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = fill(sizes)
    by_id = {r[0]: r for r in rows}
    taken = defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        _, t, s = by_id[r["doc_id"]]
        assert r["size"] == size(t) and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(slack, 0.01 * want[s]), (s, taken[s], want[s])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = QUERIES["op5_mixing"](spark, sf).collect()
    check(rows, got)
    again = QUERIES["op5_mixing"](spark, sf).collect()
    assert sorted(got) == sorted(again)


def test_many_shards_nulls_and_capped_sources(spark, docs):
    rows = [(i, "w " * (i % 60), "en", ["a", "b", None, "tiny"][0 if i % 3 else i % 4 if i % 12 else 3]) for i in range(600)]
    rows += [(1000, None, "en", "z"), (1001, " \n", "en", None), (1002, "x " * 5000, "en", "b")]
    df = docs(rows)
    got = mixing.mix_report(df, shard_words=200, block=4).collect()
    check([(r[0], r[1], r[3]) for r in rows], got, slack=40)
    out = mixing.mixed_documents(df, shard_words=200, block=4)
    assert out.columns == df.columns
    taken = defaultdict(int)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        taken[r["doc_id"]] += size(r["text"])
    assert dict(taken) == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.mix_report(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_quotas_equal_the_highest_quotients(spark):
    votes = [(f"p{i:02d}", float(v)) for i, v in enumerate([1000, 530, 530, 77, 3, 1, 1, 1, 0.5, 0])]
    for seats in (0, 1, 7, 10, 11, 100, 1234):
        df = spark.createDataFrame([(0, p, v, seats) for p, v in votes], "g int, p string, v double, n long")
        got = {r["p"]: r["won"] for r in mixing.sainte_lague(df, ["g"], "p", "v", "n", "won").collect()}
        want = dict.fromkeys(got, 0)
        for _ in range(seats):
            best = max(votes, key=lambda x: (x[1] / (2 * want[x[0]] + 1), [-ord(c) for c in x[0]]))
            want[best[0]] += 1
        assert got == want, seats


def test_repeated_rows(spark, docs):
    got = mixing.mix_report(docs([(1, "a b c d", "en", "s")] * 20 + [(2, "e", "en", "t")])).collect()
    assert len(got) == 21 and all(r["taken"] <= 2 * r["size"] for r in got)
