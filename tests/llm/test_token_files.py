"""Token files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from llm_helpers import SF, docs  # noqa: F401
from pyspark.sql import functions as F

from keepsake.llm import token_files
from keepsake.llm.queries import QUERIES
from keepsake.session import scratch_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def expected(library, rows):
    """doc_id -> (start, ids) in ascending id order, nulls first, ties by nothing (ids must be distinct)."""
    at, out = 0, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (at, ids)
        at += len(ids)
    return out


def test_query_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, (at, ids) in expected(library, rows).items()}
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op12_token_files"](spark, SF).collect()}
    assert got == want


def test_odd_texts_and_ties(spark, docs, library):  # noqa: F811
    odd = [(5, None), (3, ""), (-2, " \t\n "), (9, "Ünï a b c\x1cd é 'LL we're 12345 <|endoftext|>x"),
           (None, "a null id"), (7, "long " * 20_000 + "x" * 5000), (8, "日本語 テキスト 🙂🙂")]
    path = scratch_dir(spark)
    token_files.write_tokens(docs(odd).repartition(3), path, PATH)
    got = {r["doc_id"]: (r["start"], r["ids"]) for r in token_files.read_tokens(spark, path).collect()}
    assert got == expected(library, odd)

    same = [(1, "b c"), (1, "a"), (1, "b c"), (0, "z")]
    path = scratch_dir(spark)
    token_files.write_tokens(docs(same).repartition(4), path, PATH)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [0, 1, 1, 1]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()


def test_empty_table_and_clashing_columns(spark, docs):  # noqa: F811
    path = scratch_dir(spark)
    token_files.write_tokens(docs([]), path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0
    path = scratch_dir(spark)
    clash = docs([(1, "a b")]).withColumns({"ids": F.lit("x"), "part": F.lit(3), "a.b": F.lit(1), "meta": F.lit("m")})
    token_files.write_tokens(clash, path, PATH)
    row = token_files.read_tokens(spark, path).first()
    assert row["meta"]["ids"] == "x" and row["meta"]["part"] == 3 and row["meta"]["a.b"] == 1 and row["meta"]["meta"] == "m"


def test_encodings_row_groups_and_page_indexes(spark):
    path = scratch_dir(spark)
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs_.coalesce(1), path, PATH, row_group=64 << 10, page=8 << 10)
    folder = path.removeprefix("file:") + "/tokens"
    files = [pq.ParquetFile(f) for f in __import__("glob").glob(folder + "/*.parquet")]
    assert sum(f.metadata.num_row_groups for f in files) > len(files)
    columns = {f.metadata.row_group(0).column(k).path_in_schema: f.metadata.row_group(0).column(k)
               for f in files for k in range(f.metadata.num_columns)}
    ids = next(c for p, c in columns.items() if p.startswith("ids."))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_window_and_spans(spark):
    path = scratch_dir(spark)
    token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet").repartition(4), path, PATH)
    stream = [i for r in token_files.read_tokens(spark, path).orderBy("start").collect() for i in r["ids"]]
    for first, count in ((0, 10), (1234, 5000), (len(stream) - 3, 100), (len(stream) + 5, 10)):
        got = token_files.read_window(spark, path, first, count).orderBy("start").collect()
        assert [i for r in got for i in r["ids"]] == stream[first:first + count]
    plan = token_files.read_spans(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


TRICKY = ["word,word;x.y:z! ?", "don't I'LL we've 'S '", 'say ",no", (yes). [1,2;3] 12.5%', "épée, Été. œuvre! ñ?Ñ;ß,ẞ",
          "a×b,÷c", "e\u0301, cafe\u0301.", "<|endoftext|>,<|STARTOFTEXT|>. A,B", "<|x|> Y,Z", "İstanbul,ΣΑΣ. ǅ;", "x\u00a0,y\u2003.z",
          "，。全角、", "\u037e;\u0387", "= \u0338, <\u0338.", "a\u200d,b\ufe0f.c", "１２,Ⅳ.½;²", "\x1c,\x85.\x00;", "ſ,K.Å;"]


def test_cuts_never_change_the_ids(library):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    parts = [c for t in TRICKY for c in t] + [" ", ",", ".", "a", "S", "'", "é"] * 5
    texts = TRICKY + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    ids, ends = token_files.ChunkEncoder(PATH).encode(pa.array(texts), None)
    for k, text in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_worker_forgets_and_relearns(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", 5)
    import pyarrow as pa

    encoder = token_files.ChunkEncoder(PATH)
    for text in ("a b c d e f g", "x" * 100 + " a", "h i j a b", "", "a " * 50):
        ids, ends = encoder.encode(pa.array([text, None]), 2)
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2, 2] and ends[-1] == len(ids)
