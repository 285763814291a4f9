"""JSON documents read by several tasks: the same items as the whole-file reader."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import enrich as E
from keepsake.sources import exports as X
from keepsake.sources import large_json as L


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _write(scratch, name, text):
    folder = _local(scratch)
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _value(rng, depth=0):
    kinds = ["s", "n", "b", "z"] + (["l", "o"] if depth < 3 else [])
    k = rng.choice(kinds)
    if k == "s":
        return "".join(rng.choice(['a', ',', '"', "\\", "[", "]", "{", "}", ":", "é", "\n", " ", "🙂"]) for _ in range(rng.randrange(12)))
    if k == "l":
        return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if k == "o":
        return {f"k{j},\"": _value(rng, depth + 1) for j in range(rng.randrange(4))}
    return {"n": rng.randrange(1000) / 2, "b": True, "z": None}[k]


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_random_documents(spark, scratch, small_splits, indent):
    rng = random.Random(11)
    docs = {}
    for k in range(6):
        doc = [_value(rng) for _ in range(80)] if k % 2 else {f"m{j}\\": _value(rng) for j in range(40)} | {
            "bookmarks": [_value(rng) for _ in range(30)], "none": [], "last": 1}
        text = json.dumps(doc, ensure_ascii=k % 3 == 0, indent=indent)
        docs["file:" + _write(scratch, f"d{k}.json", text)] = doc
    rows = L.elements(spark, list(docs)).collect()
    for path, doc in docs.items():
        got = {(r["name"], r["pos"]): r["text"] for r in rows if r["path"] == path}
        want = {}
        if isinstance(doc, list):
            want = {(None, k): v for k, v in enumerate(doc)}
        else:
            for name, v in doc.items():
                want[name, None] = None if isinstance(v, list) else v
                want |= {(name, k): x for k, x in enumerate(v)} if isinstance(v, list) else {}
        assert set(got) == set(want)
        for key, v in want.items():
            assert (got[key] is None) if key[1] is None and isinstance(doc[key[0]], list) else json.loads(got[key]) == v


def test_document_is_read_by_several_tasks(spark, scratch, small_splits):
    path = _write(scratch, "one.json", json.dumps([{"id": str(k), "text": "x, y"} for k in range(2000)]))
    assert L._fragments(spark, path).rdd.getNumPartitions() > 10
    assert L.elements(spark, path).count() == 2000


def test_broken_documents_are_errors(spark, scratch, small_splits):
    for k, text in enumerate(('[1, 2', '{"a": [1, 2}', '["a, 1]', '[1, 2] , 3', "[1,, 2]", "[1]]")):
        path = _write(scratch, f"bad{k}.json", text)
        with pytest.raises(Exception, match=L.BROKEN):
            L.elements(spark, path).collect()
    for k, text in enumerate(("[]", "{}", " [ ] ", "", "just, text")):
        assert L.elements(spark, _write(scratch, f"none{k}.json", text)).count() == 0


def _posts(df):
    cols = ["file_ord", "path", "pos", "format", "id", "url", "author_handle", "text", "lang", "hashtags", "source"]
    return sorted((tuple(map(str, r)) for r in df.select(cols).collect()))


FILES = {
    "list.json": [{"id": k, "text": f"a, [b] {k}", "media": [{"url": "u"}]} for k in range(40)],
    "bookmarks.json": {"note": "x, y", "bookmarks": [{"url": f"https://x.com/u/status/{k}", "text": "t"} for k in range(30)], "data": 1},
    "data.json": {"data": [{"id": f"d{k}"} for k in range(30)]},
    "rich.json": {"bookmarks": [{"id": f"r{k}", "author": {"handle": "h", "name": "n"}, "lang": "en", "hashtags": ["a", "b"]}
                                for k in range(25)]},
    "rich_list.json": [{"id": f"q{k}", "metrics": {"likes": k}} for k in range(25)],
    "urls.json": [f"https://x.com/u/status/9{k}" for k in range(50)],
    "empty.json": {"other": [1, 2, 3]},
    "empty_first.json": {"bookmarks": [], "data": [{"id": "not read"}]},
}


def test_captures_equal_the_whole_file_reader(spark, scratch, small_splits):
    paths = [_write(scratch, name, json.dumps(doc)) for name, doc in FILES.items()]
    paths.append(_write(scratch, "urls.txt", "\n".join(f"  https://x.com/u/status/8{k} \n" for k in range(50))))
    want = _posts(X.read_captures(spark, paths))
    assert len(want) > 200 and len({r[3] for r in want}) == 3
    assert _posts(X.read_captures(spark, paths, large=1)) == want
    assert _posts(X.read_captures(spark, paths, large=1200)) == want  # some of each


def test_unsupported_export_is_an_error_either_way(spark, scratch, small_splits):
    path = _write(scratch, "odd.json", json.dumps({"bookmarks": {"a": 1}, "data": []}))
    for large in (1, 1 << 20):
        with pytest.raises(Exception, match=X.UNSUPPORTED_EXPORT):
            X.read_captures(spark, path, large=large).collect()


def test_mapping_and_records(spark, scratch, small_splits):
    entries = {f"id{k}": {"summary": f"s, {k}", "tags": ["a", 1]} for k in range(60)} | {"junk": 3, "lists": [1]}
    listed = [{"id": f"id{k}", "topic": "later"} for k in range(0, 60, 2)] + [7, {"id": ""}]
    paths = [_write(scratch, "map.json", json.dumps(entries)), _write(scratch, "list.json", json.dumps(listed))]
    got = [sorted(map(str, X.load_mapping(spark, paths, large=n).select("id", "summary", "topic", "tags").collect()))
           for n in (1, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 60
    recs = _write(scratch, "recs.json", json.dumps([{"id": k, "v": {"a": [k]}} for k in range(90)]))
    rows = [sorted((r["pos"], r["value"]) for r in X.read_records(spark, recs, large=n).collect()) for n in (1, 1 << 20)]
    assert rows[0] == rows[1] and len(rows[0]) == 90
    bad = _write(scratch, "bad.json", json.dumps([{"id": 1}, 2]))
    with pytest.raises(Exception, match=X.NOT_OBJECT):
        X.read_records(spark, bad, large=1).collect()


def test_states_compose(spark):
    """The state at every cut of a text equals that of reading it in one go."""
    rng = random.Random(3)
    text = json.dumps([_value(rng) for _ in range(30)]).encode()
    at, chars, odd, _ = L.marks(text)
    whole = L.left_open(chars[~odd])
    assert whole == (0, b"")
    for cut in range(0, len(chars), 7):
        real = ~odd
        a, b = L.left_open(chars[:cut][real[:cut]]), L.left_open(chars[cut:][real[cut:]])
        assert L.followed(a, b) == whole


def test_large_files_are_read_by_folder_not_by_a_list(spark, tmp_path):
    folders = [str(tmp_path / n) for n in "ab"]
    for k, f in enumerate(folders):
        (tmp_path / "ab"[k] / "p=1").mkdir(parents=True)
        (tmp_path / "ab"[k] / "p=1" / "x.json").write_text('[{"id": "%d"}]' % k)
        (tmp_path / "ab"[k] / "p=1" / "small.json").write_text("[]")
    assert L.large_files(spark, folders, 5) == (folders, 5)
    assert L.large_files(spark, folders, 500) is None
    assert sorted(r.text for r in L.elements(spark, folders, 5).collect()) == ['{"id": "0"}', '{"id": "1"}']
    twice = [folders[0], folders[0] + "/p=1/x.json"]
    paths, least = L.large_files(spark, twice, 5)
    assert least == 0 and len(paths) == 1 and paths[0].endswith("x.json")
    assert L.elements(spark, paths, least).count() == 1


def test_documents_are_written_into_one_folder(spark):
    from keepsake.plans.q_sources import written_documents
    docs = spark.createDataFrame([(f"export/{k}", f'[{{"id": "{k}"}}, 3]') for k in range(30)], "path string, value string")
    base = written_documents(spark, docs).removeprefix("file:")
    assert not [n for n in os.listdir(base) if os.path.isdir(os.path.join(base, n))]
    assert len([n for n in os.listdir(base) if n.endswith(".txt")]) == 30


def test_small_files_share_tasks_and_need_no_states(spark, tmp_path, monkeypatch):
    """Files that are one split are cut in one pass, by few tasks; nothing of them comes to the driver."""
    folders = [str(tmp_path / n) for n in "ab"]
    for f in "ab":
        (tmp_path / f).mkdir()
    for k in range(60):
        (tmp_path / "a" / f"{k}.json").write_text(" \n " * (k % 3) + json.dumps({f"i{k}": {"summary": f"s, {k}"}, "l": [1, {"x": [k]}], "j": k}))
        (tmp_path / "b" / f"{k}.json").write_text(json.dumps([{"id": f"i{k}", "topic": "later"}] * (k % 2) + [k]))
    (tmp_path / "b" / "urls.txt").write_text("  \n  https://a, b\n[1]")
    seen, really, plans, write = [], L.begin_states, [], L.written
    monkeypatch.setattr(L, "begin_states", lambda rows: seen.append(rows) or really(rows))
    monkeypatch.setattr(L, "written", lambda df: plans.append(df.rdd.getNumPartitions()) or write(df))
    assert len([str(r) for r in L.elements(spark, folders, 1).collect()]) == 60 * 3 + 60 * 2 + 30 + 60
    assert seen == [[]] and plans[0] <= 2 * spark.sparkContext.defaultParallelism
    got = [sorted(map(str, X.load_mapping(spark, paths, large=n).select("id", "summary", "topic").collect()))
           for n in (1, 1 << 20) for paths in (folders, [folders[0], folders[1] + "/[0-9]*.json"]) if n == 1 or "*" in paths[1]]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60
    for k, text in enumerate(('[1, 2', '{"a": [1, 2}', '["a, 1]', '[1, 2] , 3', "[1,, 2]", "[1]]")):
        path = _write(str(tmp_path), f"bad{k}.json", text)
        with pytest.raises(Exception, match=L.BROKEN):
            L.elements(spark, path).collect()
    for k, text in enumerate(("[]", "{}", " [ ] ", "", "just, text")):
        assert L.elements(spark, _write(str(tmp_path), f"none{k}.json", text)).count() == 0
