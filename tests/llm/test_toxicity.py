import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from keepsake.llm import toxicity as tox
from keepsake.llm.queries import QUERIES

INSULTS = ["idiot", "clown", "loser", "stupid", "pathetic"]
SYLLABLES = ["the", "er", "on", "ti", "an", "ing", "ble", "re", "st", "ou", "wh", "ea"]


def text(rng, bad):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
    for _ in range(rng.randint(1, 3) if bad else 0):
        words[rng.randrange(len(words))] = rng.choice(INSULTS)
    return " ".join(words)


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def kernel(a, b):
    """The gapped-subsequence kernel by its definition, each word with its start and end."""
    def spread(w):
        s = [tox.START, *tox.SYMBOLS[[ord(c) for c in w]].tolist(), tox.STOP]
        out = {}
        for at in combinations(range(len(s)), 3):
            u = tuple(s[i] for i in at)
            out[u] = out.get(u, 0.0) + tox.DECAY ** (at[2] - at[0] + 1)
        return out, sum(tox.DECAY ** (2 * (at[2] - at[0] + 1)) for at in combinations(range(len(s)), 3)) ** 0.5
    (x, nx), (y, ny) = spread(a), spread(b)
    return sum(v * y.get(u, 0.0) for u, v in x.items()) / nx / ny


def test_kernel_against_its_definition():
    words = ["idiot", "idiots", "id-iot", "clown", "abc", "banana", "über"]
    got = tox.Landmarks(words).kernel(words)
    want = np.array([[kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want)
    assert got[0, 2] > 0.5 > got[0, 3]


def test_weights_equal_the_nystroem_machine():
    marks = tox.Landmarks(["idiot", "clown", "the", "ering"])
    v = np.random.default_rng(0).normal(size=marks.whiten.shape[1])
    m = tox.Machine(marks.weights(v), 0.3, np.zeros(3))
    words = ["idiot", "cl-own", "thering", "q" * 16]
    assert np.allclose(m.margins(words), marks.map(words) @ v + 0.3)


def test_held_out_accuracy_and_written_variants(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, 0), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tox.toxicity_report(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert sum(got[r[0]]["predicted"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    m = tox.fit(docs, labels)
    rng = random.Random(8)
    plain = [text(rng, False) for _ in range(40)]
    odd = [t + " " + w for t, w in zip(plain, ["id-iot", "clo.wn", "lo*ser", "i d i o t", "stu_pid", "path-etic!"] * 6)]
    assert m.scores(odd).mean() > m.scores(plain).mean() + 0.4


def test_odd_texts_and_missing_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "𝄞 é \n"), (None, "idiot"), (2, "")],
                               "doc_id long, text string").withColumn("score", F.lit("kept?"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tox.toxicity_report(df, none).collect()
    assert len(got) == 6 and all(r["score"] < 0.01 for r in got)
    rows = corpus(120, 2)
    m = tox.train([r[1] for r in rows], [r[2] for r in rows], 0.25)
    out = tox.score_documents(df, m, out_col="toxic").collect()
    assert len(out) == 6 and all(0 <= r["toxic"] <= 1 for r in out) and out[0]["score"] == "kept?"
    assert tox.score_documents(df.limit(0), m).count() == 0
    assert m.scores([None, ""])[0] < 0.5


def test_query_runs_over_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in got} == ids and len(got) == len(ids)


def test_insults_gapped_by_blanks_and_line_breaks():
    rows = corpus(400, 1)
    m = tox.train([r[1] for r in rows], [r[2] for r in rows], 0.25)
    rng = random.Random(9)
    plain = [text(rng, False) for _ in range(42)]
    gapped = ["id iot", "clo wn", "lo\nser", "i d\ni o t", "stu p id", "path -\netic", "p a t\nh e t i c"]
    odd = [t.replace(" ", f" {w} ", 1) for t, w in zip(plain, gapped * 6)]
    assert m.scores(odd).mean() > m.scores(plain).mean() + 0.4
    assert sum(m.scores([t]).item() >= 0.5 for t in odd) >= 0.9 * len(odd)


def test_runs_of_words_against_plain_python():
    rng = random.Random(3)
    texts = ["a b c", None, "", "x" * 40 + " é𝄞 - ab", "one", "id iot\nyou"] + [
        " ".join("ab-c"[:rng.randint(1, 4)] * rng.randint(1, 3) for _ in range(60)) for _ in range(5)]
    m = tox.Machine(np.random.default_rng(1).normal(size=tox.ALPHABET ** 3), 0.2, np.zeros(3))
    stream, got = tox.Stream(texts), []
    for owner, at, n in stream.runs(block=7):
        margins = m.run_margins(stream, at, n, block=5)
        got += [(o, stream.joined[a:a + n], round(v, 3)) for o, a, v in zip(owner.tolist(), at.tolist(), margins.tolist())]
    want = []
    for i, t in enumerate(texts):
        words = [w for w in map(tox.clean_word, (t or "").lower().split()) if w]
        runs = ["".join(words[a:b]) for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
        want += [(i, r) for r in runs if 3 <= len(r) <= tox.WINDOW]
    assert sorted(g[:2] for g in got) == sorted(want)
    assert np.allclose([g[2] for g in got], m.margins([g[1] for g in got]), atol=2e-3)
    best = m.best_runs(stream, len(texts))[0]
    assert all(np.isclose(best[i], max((g[2] for g in got if g[0] == i), default=-np.inf), atol=2e-3)
               for i in range(len(texts)))


def _margin(machine, text):
    """A text's margin by the kernel's definition: every triple of places, one after the other."""
    s = [tox.START, *(int(tox.SYMBOLS[min(ord(c), 0x2FFF)]) for c in text), tox.STOP]
    total = norm = 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                weight = tox.DECAY ** (k - i + 1)
                total += weight * float(machine.weights[(s[i] * tox.ALPHABET + s[j]) * tox.ALPHABET + s[k]])
                norm += weight ** 2
    return total / norm ** 0.5 + machine.offset


def _two_margins(machine, text):
    words = [max([_margin(machine, w) for w in tox.windows_of(tox.clean_word(t)) if len(w) >= 3], default=-np.inf)
             for t in tox.tokens(text)]
    first, second = sorted([*words, tox.CLEAN, tox.CLEAN])[:-3:-1]
    clean = [w for w in map(tox.clean_word, text.lower().split()) if w]
    runs = ["".join(clean[a:z]) for a in range(len(clean)) for z in range(a + 2, len(clean) + 1)]
    best = max([_margin(machine, r) for r in runs if 3 <= len(r) <= tox.WINDOW], default=-np.inf)
    return (best, first) if best > first else (first, second)


def test_margins_of_documents_by_definition():
    rng = np.random.default_rng(8)
    machine = tox.Machine(rng.normal(0, 1, tox.ALPHABET ** 3).astype(np.float32), -0.4, np.array([0.1, 1.0, 0.5]))
    words = ["id", "iot", "worth", "less", "the", "a", "x", "of", "«quoted»", "émile", "12", "n-o", "--", "straßenbahnhaltestelle"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(40)] + ["", None, "a\nb\tc d", "the of the of the of the of"]
    got = machine.document_margins(texts)
    for text, margins in zip(texts, got):
        want = _two_margins(machine, text) if text else (tox.CLEAN, tox.CLEAN)
        assert np.allclose(margins, want, atol=1e-3), text
    assert np.allclose(machine.scores(texts), 1 / (1 + np.exp(-(tox._design(got) @ machine.logistic))))


def test_equal_runs_are_computed_once():
    stream = tox.Stream(["of the house of the house", "of the mouse"])
    for owner, at, n in stream.runs():
        first, which = stream.distinct(at, n)
        codes = [bytes(stream.codes[k:k + n]) for k in at]
        assert [bytes(stream.codes[first[w]:first[w] + n]) for w in which] == codes and len(first) == len(set(codes))


def test_scoring_leaves_blas_threads_alone(monkeypatch):
    class NoProduct(np.ndarray):
        def __matmul__(self, other):
            raise AssertionError("a thin product by BLAS")
    rng = np.random.default_rng(2)
    m = tox.Machine(rng.normal(size=tox.ALPHABET ** 3).astype(np.float32).view(NoProduct), 0.2, np.zeros(3))
    words = ["".join(rng.choice(list("abcdefgh"), 14)) for _ in range(300)]
    got = m.margins(words)
    want = [0.2 + float(np.asarray(m.weights)[c].astype(float) @ w) for _, code, w in tox.codes_by_length(words) for c in code]
    assert np.allclose(got, want)


def test_margins_of_tokens_are_remembered(monkeypatch):
    m = tox.Machine(np.random.default_rng(1).normal(size=tox.ALPHABET ** 3), 0.2, np.zeros(3))
    texts = ["some words, some of them twice", None, "", "a b", "more words of 16charactersandmorethanthat"]
    first = m.document_margins(texts)
    asked = []
    monkeypatch.setattr(m, "margins", lambda words: asked.extend(words) or np.zeros(len(words)))
    assert np.array_equal(m.document_margins(texts), first) and not asked
    monkeypatch.undo()
    monkeypatch.setattr(tox, "REMEMBER", 3)
    assert np.array_equal(m.document_margins(texts[::-1])[::-1], first)
    assert np.array_equal(m.document_margins([]), np.zeros((0, 2)))
