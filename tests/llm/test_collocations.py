"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
from llm_helpers import docs  # noqa: F401
from pyspark.sql import functions as F

from keepsake.llm import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = set()
    for lang in total:
        best = []
        for (la, w), a in cands.items():
            if la != lang or len(w) == 2 and any(100 * n >= 50 * a and w in (x[:2], x[1:]) for (lb, x), n in cands.items()
                                                 if lb == lang and len(x) == 3):
                continue
            score, _, k = min((10 ** 6 * a * a // (f[la, w[:k]] * f[la, w[k:]]), k, k) for k in range(1, len(w)))
            best.append((-score, -a, " ".join(w).encode(), f[la, w[:k]], f[la, w[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "new", "york", "times", "of", "é", "L'été", "日本", "x-y", "a b", "Of", "big"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(rng.randrange(60)))
        rows.append((k, text, rng.choice(["en", "en", "fr", None, "und", ""]), "s"))
    return rows


ROWS = made(3, 300) + [(900, None, "en", "s"), (901, "", None, "s"), (902, "...", "zz", "s"), (903, "one two", "yy", "s"),
                       (904, "hot pair " * 3000, "en", "s"), (905, "w" * 30000, "en", "s")]


def got(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).collect()}


def test_equals_brute_force(docs):  # noqa: F811
    assert got(docs(ROWS).repartition(5)) == brute(ROWS)


def counted(runs, least=1):
    rows = collocations.merged_counts(runs, least).collect()
    assert len({(r["lang"], r["phrase"]) for r in rows if r["n_words"]}) == sum(r["n_words"] > 0 for r in rows)
    return {(r["lang"], r["phrase"]): r["f"] for r in rows if r["n_words"]}


def test_runs_and_partitions_change_nothing(docs, spark):  # noqa: F811
    whole = collocations.phrase_runs(docs(ROWS).coalesce(1), partitions=1)
    assert whole.count() == whole.select("lang").distinct().count()
    want = counted(whole)
    assert want[("en", "hot pair hot")] == 2999 and want[("en", "hot pair")] == 3000 and want[("en", "hot")] == 3000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        runs = collocations.phrase_runs(docs(ROWS).coalesce(1), held=40, partitions=7)
        assert runs.groupBy("partition", "lang").count().filter("count > 1").count() > 0  # several runs
        assert counted(runs) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counted(collocations.phrase_runs(docs(ROWS).repartition(6), held=10), 5) == {k: n for k, n in want.items() if n >= 5}


def test_merging_runs_with_many_words_uses_the_long_way():
    """Keys that pass 63 bits are sorted column by column."""
    row = {"words": b"a b", "entries": 2, "first": bytes([1, 1]), "second": bytes([0, 2]), "third": bytes([0, 1]), "n": bytes([3, 2])}
    many = {"words": " ".join(f"w{k}" for k in range(2_200_000)).encode(), "entries": 1, "first": b"\1", "second": b"\0",
            "third": b"\0", "n": b"\7"}
    for rows, kinds in (([row, row], 3), ([row, many, row], 2_200_003)):
        first, second, third, n, words = collocations.merge(rows)
        assert len(words) + 1 == kinds and n.tolist()[:2] == [6, 4]
        assert (first[1], second[1], third[1]) == (1, 2, 1) and words[0].as_py() == b"a"


def test_trie_bursts_and_gives_whole_subtrees():
    from collections import Counter

    rng = np.random.default_rng(4)
    trie, want = collocations.HatTrie(burst=8), Counter()
    for _ in range(30):
        words = np.where(rng.random((200, 3)) < 0.5, 1, rng.integers(1, 60, (200, 3)))
        keys, n = np.unique(words @ np.array([1 << 42, 1 << 21, 1]), return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist())))
    assert 1 in trie.below and trie.below[1].below  # burst twice
    total = trie.held
    got = Counter()
    while trie.held:
        keep = trie.held // 2
        keys, n = trie.take(keep)
        assert trie.held <= keep and (np.diff(keys) > 0).all()
        got.update(dict(zip(keys.tolist(), n.tolist())))
    assert got == want and total >= len(want) and not trie.root and not trie.below


def test_more_words_than_numbers(docs, spark):  # noqa: F811
    """One text with more distinct words than a task numbers at a time."""
    text = " ".join(f"w{k}" for k in range(1_200_000)) + " . " + "again and again " * 30
    rows = collocations.merged_counts(collocations.phrase_runs(docs([(1, text, "en", "s")])), 10).collect()
    assert {r["phrase"]: r["f"] for r in rows if r["n_words"]} == {
        "again": 60, "and": 30, "again and": 30, "and again": 30, "again again": 29, "again and again": 30,
        "and again again": 29, "again again and": 29}
    assert sum(r["f"] for r in rows if not r["n_words"]) == 1_200_000 + 90


def test_empty_repeats_and_extra_columns(docs):  # noqa: F811
    assert got(docs([])) == set()
    twice = made(8, 40) * 2
    extra = docs(twice).withColumns({"phrase": F.lit(1), "n": F.lit(2), "f": F.lit(3), "a.b": F.lit(0)})
    assert got(extra) == brute(twice)
    assert got(docs(twice), least=4, top=3) == brute(twice, 4, 3)
