"""Source divergence against plain Python."""

import re
from collections import Counter, defaultdict

from llm_helpers import docs  # noqa: F401
from pyspark.sql import functions as F

from keepsake.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, top=200):
    held, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for n, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(UPPER)):
            held[lang, t].add(n)
            counts[lang, source][t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (la, t), d in held.items() if la == lang and len(d) >= least)
        sources = sorted(s for la, s in groups if la == lang)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


def got(df):
    return {tuple(r) for r in divergence.divergence_audit(df).collect()}


LONG = "internationalisierungsbestrebungen" * 3
ROWS = ([(k, f"Common words here and {'rare' + chr(97 + k) * k} {LONG if k % 4 == 0 else LONG[:-1]} épée ÉPÉE {LONG}x", "en", f"s{k % 3}")
         for k in range(14)]
        + [(100 + k, "der die das und ein wenig abcd abcde abcdefgh abcdefghi", "de", None) for k in range(3)]
        + [(200, None, None, None), (201, "", "xx", "empty"), (202, "1 2 3 _", "xx", "none"), (203, "der " * 5, "de", "a"),
           (204, "日本 日本 日本", "ja", "a"), (205, "日本 x", "ja", "b"), (206, "日本y 日本", "ja", "b")])


def test_equals_brute_force(docs):  # noqa: F811
    assert got(docs(ROWS).repartition(3)) == brute(ROWS)


def test_repeats_order_and_extra_columns(docs):  # noqa: F811
    twice = ROWS + ROWS[:5] + [ROWS[16]] * 4
    extra = docs(twice).withColumns({"item": F.lit(1), "whole": F.lit(True), "p": F.lit(2), "a.b": F.lit(0)})
    assert got(extra.repartition(2)) == brute(twice)


def test_empty_table(docs):  # noqa: F811
    assert got(docs([])) == set()


def test_small_blocks_and_steps(docs):  # noqa: F811
    assert {tuple(r) for r in divergence.divergence_audit(docs(ROWS), block=200, pairs=5).collect()} == brute(ROWS)


def test_small_maps_only_let_more_through(docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(divergence, "MAP_BITS", 1 << 15)
    words = [(k, " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}longer" for j in range(k, k + 60)), "en", f"s{k % 4}")
             for k in range(60)]
    assert got(docs(words)) == brute(words)


def test_only_kept_prefixes_are_extended(spark, docs):  # noqa: F811
    bags = divergence.term_bags(docs([(k, f"abcdefgh{'xyz'[k % 3] * 9} zzzz{k}", "en", "s") for k in range(6)]))
    groups = spark.sparkContext.broadcast(divergence.Groups(bags))
    assert {bytes(r["item"]) for r in divergence.kept_terms(bags, groups, 2).collect()} == {
        *(f"abcdefgh{c * 9}".encode() for c in "xyz"), b"zzzz"}
    assert {bytes(r["item"]) for r in divergence.kept_terms(bags, groups, 3).collect()} == {b"zzzz"}
