import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from keepsake.llm import mixing
from keepsake.llm.common import materialise
from keepsake.llm.queries import quality_sql, tokenizer_path
from test_minhash import brute
from llm_helpers import docs  # noqa: F401

SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_each_stage_against_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = materialise(steps["quality rules"](spark, docs, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {i for i, k in con.execute(quality_sql("doc_id, kept")).fetchall() if k}
    assert good.columns == columns and sorted(r[0] for r in good.select("doc_id").collect()) == sorted(want)
    assert 0.6 * len(text) < len(want) < len(text)

    once = materialise(steps["exact dedup"](spark, good, SF))
    last = {}
    for i in sorted(want):
        last[low(text[i])] = i
    assert once.columns == columns and sorted(r[0] for r in once.select("doc_id").collect()) == sorted(last.values())

    apart = materialise(steps["near dedup"](spark, once, SF))
    keep = [r[0] for r in brute([(i, text[i]) for i in sorted(last.values())]) if r[3]]
    assert apart.columns == columns and sorted(r[0] for r in apart.select("doc_id").collect()) == keep

    mixed = materialise(steps["mixing"](spark, apart, SF))
    assert mixed.columns == columns
    report = {r["doc_id"]: r for r in mixing.mix_report(apart).collect()}
    taken, pieces = Counter(), defaultdict(list)
    for r in mixed.collect():
        taken[r["doc_id"]] += size(r["text"])
        pieces[r["doc_id"]].append(r["text"])
        words = iter(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert all(w in words for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"]))  # in the document's order
    assert taken == Counter({i: r["taken"] for i, r in report.items() if r["taken"]})

    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    out = Counter(tuple(r) for r in steps["bpe"](spark, mixed, SF).collect())
    wanted = Counter()
    for i, texts in pieces.items():
        for t in texts:
            ids = lib.encode(t, add_special_tokens=False).ids
            wanted[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert out == wanted
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == wanted


def test_empty_table_and_odd_rows(spark, docs):
    for rows in ([], [(1, None), (None, "a b"), (2, ""), (3, "x " * 100), (3, "x " * 100)]):
        df = docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            df = materialise(stage(spark, df, SF))
        assert df.count() >= 0
