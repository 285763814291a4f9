"""The q-gram index of rules against one expression per rule."""

from __future__ import annotations

import random
import re

from conftest import post, posts_df
from keepsake.functions.rulesets import DEFAULT_CATEGORIES, rule_rows
from keepsake.operators import rule_index as RI
from keepsake.operators import rules as R
from pyspark.sql import functions as F
from test_plans import plan_text

WORDS = ["ai", "rust", "trust", "Ópera", "inflación", "ſtar", "ıt", "go", "x_ai", "new york", "σας", "ΣΑΣ", "api", "c++", "K", "K",
         "µm", "μm", "straße", "STRASSE", "fact-check", "fact check", "hugging face", "colour", "color"]
CATS = [("A", [r"\bai\b", "rust", r"star\b", "it", r"ópera"], ["example.com", "uk"]),
        ("B", [r"new york", "fact.?check", "hugging ?face", r"colou?r", r"\bgo\b", "σας", "c\\+\\+", "k"], ["b.example.com"]),
        ("C", [r"\d+", "api|trust", "μm", "[xy]_ai", "GO", r"\bstraße\b", "é|ó"], ["example.com", ""]),
        ("D", ["never seen anywhere", r"\bnever\b"], [])]


def _random_posts(spark, n=150):
    rnd = random.Random(5)
    hosts = ["https://www.example.com/x", "http://a.b.example.com", "https://bexample.com", "//co.uk/p", "mailto:x", "http://uk."]
    return posts_df(spark, [post(i, text=" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(7))), hashtags=[rnd.choice(WORDS)],
                                 links=[rnd.choice(hosts) for _ in range(rnd.randrange(3))]) for i in range(n)])


def _rows(df):
    return sorted(tuple(r) for r in df.select("id", "category", "ord", "kw_points", "dom_points", "score").collect())


def test_index_equals_expressions(spark):
    posts = _random_posts(spark)
    assert _rows(RI.category_points(posts, R.rules_frame(spark, CATS))) == _rows(R.category_points(posts, CATS))
    both = [sorted(map(tuple, f.select("id", F.array_join("categories", "|")).collect()))
            for f in (RI.categorize(posts, R.rules_frame(spark, CATS)), R.categorize(posts, CATS))]
    assert both[0] == both[1]


def test_default_rules_and_repeats(spark):
    posts = _random_posts(spark, 40).unionByName(_random_posts(spark, 3))
    rules = R.rules_frame(spark, DEFAULT_CATEGORIES)
    assert _rows(RI.category_points(posts, rules)) == _rows(R.category_points(posts, DEFAULT_CATEGORIES))
    doubled = [(c, kws * 2, doms * 2) for c, kws, doms in CATS]
    assert _rows(RI.category_points(posts, R.rules_frame(spark, doubled))) == _rows(R.category_points(posts, doubled))


def test_ten_thousand_rules_without_a_nested_loop(spark):
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(10_000)]
    cats = [(f"c{k % 40}", [rf"\b{w}\b" if k % 2 else w], []) for k, w in enumerate(words)]
    posts = posts_df(spark, [post(k, text=" ".join(rnd.choice(words) for _ in range(20))) for k in range(30)])
    points = RI.category_points(posts, R.rules_frame(spark, cats))
    assert "NestedLoop" not in plan_text(points) and "Cartesian" not in plan_text(points)
    want = {}
    for k in posts.collect():
        hay = "  ".join([k.text, "", "", (k.author_handle or "").lower()])
        tokens = set(re.split(r"\W+", hay))
        for n, w in enumerate(words):
            if w in tokens if n % 2 else w in hay:
                want[k.id, n] = want.get((k.id, n), 0) + 1
    assert {(r["id"], r["ord"]): r["kw_points"] for r in points.collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], R.RULE_SCHEMA)
    assert RI.category_points(_random_posts(spark, 3), none).count() == 0
    assert RI.category_points(posts_df(spark, []), R.rules_frame(spark, CATS)).count() == 0


def test_guards_are_exact_for_every_letter(spark):
    """Guarded and plain search agree for every letter against every text of one character and its other cases."""
    letters = [chr(c) for c in range(0x20, 0x2100) if chr(c).isalpha()]
    texts = spark.createDataFrame([(c, f) for c in letters for f in {c, c.upper(), c.lower(), c.swapcase(), c.title()}], "c string, t string")
    variants = texts.select("c", F.lower("t").alias("hay")).withColumn("fold", R.has_fold_specials(F.col("hay")))
    folded = {}
    for c in letters:
        folded.setdefault(R._fold(c), []).append(c)
    rows = [(c, o) for group in folded.values() for c in group for o in group]  # letters that may match each other
    pairs = spark.createDataFrame(rows, "p string, t string").select("p", F.lower("t").alias("hay"))
    hit = pairs.where(F.rlike("hay", F.concat(F.lit("(?iuU)"), F.col("p")))).where(~R.has_fold_specials(F.col("hay")))
    found = hit.collect()
    assert found
    for r in found:
        literals = R.required_literals(r["p"])
        assert literals is None or any(x in r["hay"] for x in literals), r
    own = variants.where(~F.col("fold") & F.rlike("hay", F.concat(F.lit("(?iuU)"), F.col("c")))).collect()
    assert len(own) > 5000
    for r in own:
        literals = R.required_literals(r["c"])
        assert literals is None or any(x in r["hay"] for x in literals), r


def test_rule_rows_still_flatten():
    assert len(rule_rows(CATS)) == sum(len(k) + len(d) for _, k, d in CATS)


def test_rules_that_their_key_decides_need_no_haystack(spark):
    made = {p: RI.compile_pattern(p) for p in (r"\brust\b", "ai", "inflac", "inflación", r"\bnew york\b", r"colou?r", "σας")}
    assert [p for p, m in made.items() if m["sure"]] == [r"\brust\b", "ai", "inflac"]
    assert made["inflación"]["literals"] == [["6:inflac", "6:nflaci", "6:flació", "6:lación"]]
    assert made["inflación"]["bare"] == "inflación" and made["σας"]["bare"] is None
    posts = posts_df(spark, [post(1, text="inflación rust ai"), post(2, text="inflacion trust xaix"), post(3, text="ınflac ruſt")])
    cats = [(p, [p], []) for p in made if "y" not in p]
    assert _rows(RI.category_points(posts, R.rules_frame(spark, cats))) == _rows(R.category_points(posts, cats))


def test_a_key_travels_once_a_block(spark):
    """Only rules' keys are exchanged, with the numbers of the posts that hold them, not a row for every post and text."""
    texts = ["rust in new yorks", "trust, and no rust", "ınflac ruſt", "", "é new york"] * 20
    hays = spark.createDataFrame(list(enumerate(texts)), "row long, hay string").coalesce(1)
    keys = spark.createDataFrame([("w:rust",), ("t:new york",), ("t:inflac",), ("t:trust",), ("t:é",), ("w:never",)], "key string")
    found = {(r.key, r.block): r["at"] for r in RI.postings(hays, keys).collect() if r.key in {k.key for k in keys.collect()}}
    of = {"w:rust": (0, 1, 2), "t:new york": (0, 4), "t:inflac": (2,), "t:trust": (1,), "t:é": (4,)}
    assert found == {(k, 0): [n for n in range(100) if n % 5 in at] for k, at in of.items()}
    far = hays.selectExpr("row * 30000 as row", "hay")
    assert {r.block + x for r in RI.postings(far, keys).collect() if r.key == "t:é" for x in r["at"]} == {
        n * 30000 for n in range(100) if n % 5 == 4}


def test_texts_are_found_across_windows(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(RI, "WINDOW", 7)
    texts = ["ai", "ção", "inflación", "inflac", "x"]
    sizes = sorted({len(x.encode()) for x in texts})
    told = RI.KeyMap(b"\xff" * (1 << 13), True, sizes)  # lets all through
    hays = ["", "a inflación maior", "não", "é" * 9, "", "x"]
    hay, cut = told.known_texts(pa.array(hays))
    want = {(n, t) for n, h in enumerate(hays) for t in texts if t in h}
    assert {x for x in zip(hay.tolist(), cut.to_pylist()) if x[1] in texts} == want
    assert all(t is None or t in hays[n] for n, t in zip(hay.tolist(), cut.to_pylist()))
    words = pa.array(["aa", "", "b" * 40, "aa"])
    data, ends = RI._text_bytes(words)
    whole = RI._Rolling(data).of(ends[:-1], ends[1:])
    assert whole[0] == whole[3] and len(np.unique(whole)) == 3 and told.known_words(words).all()
    assert not RI.KeyMap(bytes(1 << 13), True, sizes).known_words(words).any()


def test_plain_patterns_have_the_keys_of_the_long_way():
    for p in (r"\brust\b", r"rust\b", "ai", "Straße", "inflación", "x_1", "σας", r"\Bai", r"\bai", "ıt", "new york", r"\bnew york\b", "İx"):
        made, (decided, regex, keys) = RI.compile_pattern(p), RI.rule_keys(p)
        assert decided == bool(made["sure"] or made["bare"]) and regex == (None if decided else made["regex"])
        assert keys == (made["literals"][0] if made["sure"] and not made["bare"] else [f"t:{x}" for x in made["any_of"]])
