import hashlib
import random

import numpy as np
import pytest

from keepsake.llm import bpe
from keepsake.llm.queries import QUERIES, tokenizer_path
from llm_helpers import docs  # noqa: F401


@pytest.fixture(scope="module")
def ours():
    return bpe.load(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def same(ours, library, text):
    packed = ours.encode(text)
    ids, decoded = want(library, text)
    assert list(np.frombuffer(packed, "<u4")) == ids, text[:200]
    assert ours.decode(packed) == decoded


HARD = [None, "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaa", "It's WE'LL they'd 've", "ΣΑΣ Σ İstanbul ﬁ é é Å",
        "<|endoftext|>x<|startoftext|> <|endoftext|", "\x1c!\x1d?\x1f a\x85b c　d", "日本語テキスト 🙂👩‍👩‍👧 ½²٣",
        "123 4567 ١٢", "​zero﻿width", "x" * 3000, "ab" * 2000, "!?" * 500, "</w> th</w>e", " a",
        "q̣̇ 가", "\u0000\u0001"]


def test_hard_texts(ours, library):
    for t in HARD:
        if t is not None:
            same(ours, library, t)
    assert ours.encode(None) == b"" and ours.decode(b"") == ""


def test_random_words_against_the_library(ours, library):
    rng = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoinsh", "ab", "éèüñaeiou", "!?.,-*#", "the ing tion "]
    for _ in range(4000):
        same(ours, library, "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(1, 40))))


def test_every_token_spelled_out(ours, library):
    for token in list(library.get_vocab())[::7]:
        same(ours, library, token.replace("</w>", ""))


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op4_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = want(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_operator_keeps_columns_and_decodes(spark, docs):
    df = docs([(1, None), (2, "Hello hello"), (2, "Hello hello")])
    out = bpe.encode_documents(df, tokenizer_path()).selectExpr("doc_id", "lang", "bpe.ids", "bpe.decoded as was")
    rows = bpe.decode_ids(out, tokenizer_path()).collect()
    assert [(r["lang"], r["was"], r["decoded"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [
        ("en", "", ""), ("en", "hello</w> hello</w>", "hello</w> hello</w>"), ("en", "hello</w> hello</w>", "hello</w> hello</w>")]
    assert bpe.encode_documents(df.limit(0), tokenizer_path()).count() == 0


def test_ids_leave_a_worker_in_pieces(spark):
    import pandas as pd

    texts = [None, ""] + [f"word{i} and more" for i in range(1201)]
    pieces = list(bpe._round_trip(tokenizer_path()).func(iter([pd.Series(texts), pd.Series([], dtype="object")])))
    assert max(map(len, pieces)) <= bpe.PIECE and len(pieces[-1]) == 0
    whole = pd.concat(pieces, ignore_index=True)
    t = bpe.load(tokenizer_path())
    assert list(whole["ids"]) == [t.encode(x) for x in texts] and list(whole["decoded"]) == [t.decode(t.encode(x)) for x in texts]
