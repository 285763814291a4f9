import random
import re
from collections import defaultdict

import numpy as np

from keepsake.llm import minhash
from keepsake.llm.queries import QUERIES
from llm_helpers import docs  # noqa: F401


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(n_shingles, component) per row, by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    tried = set()
    for at in where.values():
        for i in at:
            for j in at:
                if i < j and (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op7_minhash_dedup"](spark, sf)) == brute(rows)


def test_chains_small_texts_and_repeats(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [(1, None), (2, ""), (3, "  \n"), (4, "A b"), (5, "a  B\t"), (6, "a b c"), (7, "x" * 50), (7, "x" * 50)], 100
    for _ in range(6):  # chains: each text differs from the one before by one word
        words = [word() for _ in range(60)]
        for _ in range(14):
            words[rng.randrange(60)] = word()
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n + 1, "long " * 30000), (n + 2, "LONG " * 30000), (n + 3, "y" * 3_000_000 + " z"), (n + 4, "y" * 3_000_000 + "  z")]
    assert got(minhash.near_groups(docs(rows))) == brute(rows)
    keep = {r[0] for r in brute(rows) if r[3]}
    assert {r["doc_id"] for r in minhash.drop_near_copies(docs(rows)).collect()} == keep
    assert minhash.near_groups(docs([])).count() == 0


def test_many_near_copies_of_one_text(spark, docs):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(80)] = f"v{rng.randrange(9000)}"
        rows.append((i, " ".join(w)))
    assert got(minhash.near_groups(docs(rows))) == brute(rows)


def test_pruning_keeps_what_may_reach_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (4000, minhash.HASHES)).astype(np.uint16)
    for s, low, high in ((0.75, 0.999, 1.0), (0.9, 1.0, 1.0), (0.3, 0.0, 0.001)):
        b = np.where(rng.random(a.shape) < s, a, a ^ 1)
        assert low <= minhash.plausible(a, b).mean() <= high


def test_estimates_follow_the_similarity():
    texts = [" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(50, 250))]
    n, sig = minhash.sign(texts)
    assert list(n) == [196, 196]
    v = sig.view(np.uint16).reshape(2, -1)
    assert abs((v[0] == v[1]).mean() - 146 / 246) < 0.15


def test_of_equal_buckets_one_stays_open(spark):
    groups = object.__new__(minhash.NearGroups)
    members = spark.createDataFrame([(band, value, node, node) for band, value, nodes in (
        (0, 7, (1, 2, 3)), (4, 9, (3, 2, 1)), (4, 8, (1, 2)), (5, 8, (1, 4))) for node in nodes],
        "band int, value long, node long, comp long")
    comps = spark.createDataFrame([(1, 1), (4, 1)], "node long, comp long")
    left = sorted((r["band"], r["value"], r["node"], r["comp"]) for r in groups._open(members, comps).collect())
    assert left == [(0, 7, 1, 1), (0, 7, 2, 2), (0, 7, 3, 3), (4, 8, 1, 1), (4, 8, 2, 2)]
