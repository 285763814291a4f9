"""End-to-end jobs over a snapshot store (ingest -> enrich -> render)."""

from __future__ import annotations

import json
import os

from keepsake import jobs
from keepsake.functions.rulesets import SAMPLE_CATEGORIES
from keepsake.operators import enrich as E
from test_ingest import SAMPLE

NOW = "2025-01-01T00:00:00+00:00"


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_build_twice_is_stable(spark, scratch):
    base = _local(scratch)
    os.makedirs(base, exist_ok=True)
    with open(base + "/export.json", "w", encoding="utf-8") as f:
        json.dump(SAMPLE, f)
    store = scratch + "/store"
    kw = dict(enricher=E.rules_enricher(SAMPLE_CATEGORIES), offline=True, now=NOW)
    first = jobs.build_job(spark, store, scratch + "/out1", [base + "/export.json"], **kw)
    assert first["ingest"]["added"] == 4
    assert (first["enrich"]["enriched"], first["enrich"]["errors"]) == (4, 0)
    assert first["render"]["posts"] == 4
    second = jobs.build_job(spark, store, scratch + "/out1", [base + "/export.json"], **kw)
    assert second["ingest"]["added"] == 0
    assert (second["enrich"]["enriched"], second["enrich"]["errors"]) == (0, 0)
    assert second["enrich"]["version"] == first["enrich"]["version"]  # nothing changed, nothing committed
    assert spark.read.text(scratch + "/out1/site").count() == 4


def test_dump_apply_and_records(spark, scratch):
    base = _local(scratch)
    os.makedirs(base, exist_ok=True)
    with open(base + "/export.json", "w", encoding="utf-8") as f:
        json.dump(SAMPLE, f)
    store = scratch + "/store"
    jobs.ingest_job(spark, store, [base + "/export.json"])
    d = jobs.dump_job(spark, store, scratch + "/dump", chunks=3)
    assert d["pending"] == 4 and spark.read.json(scratch + "/dump").count() == 4
    with open(base + "/map.json", "w", encoding="utf-8") as f:
        json.dump({"1001": {"summary": "s", "topic": "t", "tags": ["X"]}}, f)
    res = jobs.apply_job(spark, store, [base + "/map.json"], now=NOW)
    assert (res["enriched"], res["errors"]) == (1, 3)
    with open(base + "/empty.json", "w", encoding="utf-8") as f:
        json.dump({}, f)
    import pytest
    with pytest.raises(ValueError):
        jobs.apply_job(spark, store, [base + "/empty.json"])
    # record collections: put twice (second is a no-op), get, list
    with open(base + "/recs.json", "w", encoding="utf-8") as f:
        json.dump([{"id": "a", "v": 1}, {"id": "b", "v": 2}], f)
    rs = scratch + "/records"
    assert jobs.record_put(spark, rs, "cars", [base + "/recs.json"], batch_ts="t1")["stored"] == 2
    assert jobs.record_put(spark, rs, "cars", [base + "/recs.json"], batch_ts="t2")["stored"] == 0
    got = jobs.record_get(spark, rs, "cars", "b").first()
    assert json.loads(got.data)["v"] == 2 and got.updated_at == "t1"
    assert [r.id for r in jobs.record_list(spark, rs, "cars").collect()] == ["a", "b"]


def _stored(root):
    folder = _local(root)
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names
            if f.endswith(".parquet") and "/_" not in d}


def test_enriching_and_putting_leave_stored_files(spark, scratch):
    base = _local(scratch)
    os.makedirs(base, exist_ok=True)
    with open(base + "/many.json", "w", encoding="utf-8") as f:
        json.dump([{"id": str(k), "text": f"the text {k}"} for k in range(300)], f)
    store = scratch + "/store"
    jobs.ingest_job(spark, store, [base + "/many.json"])
    before = _stored(store)
    kw = dict(enricher=E.rules_enricher(SAMPLE_CATEGORIES), offline=True)
    first = jobs.enrich_job(spark, store, limit=100, now=NOW, **kw)
    again = jobs.enrich_job(spark, store, limit=100, now="2026-01-01T00:00:00+00:00", **kw)
    assert first["enriched"] == again["enriched"] == 100
    after = _stored(store)
    assert before.items() <= after.items()
    written = spark.read.parquet(*[f for f in after if f not in before])
    assert written.count() == 200  # the touched posts alone
    posts = jobs.SnapshotStore(spark, store).read()
    assert posts.count() == 300 and posts.where("enriched").count() == 200
    assert posts.where("enriched_at = '" + NOW + "'").count() == 100
    jobs.fold_job(spark, store)
    folded = jobs.SnapshotStore(spark, store).read()
    assert folded.count() == 300 and folded.where("enriched").count() == 200

    recs, root = base + "/recs.json", scratch + "/records"
    with open(recs, "w", encoding="utf-8") as f:
        json.dump([{"id": str(k), "v": k} for k in range(50)], f)
    jobs.record_put(spark, root, "cars", [recs], batch_ts="t1")
    before = _stored(root)
    with open(recs, "w", encoding="utf-8") as f:
        json.dump([{"id": str(k), "v": k + (k == 7)} for k in range(52)], f)
    got, ids = jobs.put_records(spark, root, "cars", [recs], batch_ts="t2")
    assert got["stored"] == 3 and ids.count() == 52
    assert before.items() <= _stored(root).items()
    rows = {r.id: (json.loads(r.data)["v"], r.updated_at) for r in jobs.record_list(spark, root, "cars").collect()}
    assert len(rows) == 52 and rows["7"] == (8, "t2") and rows["8"] == (8, "t1") and rows["51"] == (51, "t2")


def test_copying_a_collection_and_choosing_an_enricher(spark, scratch, capsys):
    base = _local(scratch)
    os.makedirs(base + "/data", exist_ok=True)
    with open(base + "/data/cars.ndjson", "w", encoding="utf-8") as f:
        f.write('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n')
    root = scratch + "/copied"
    assert jobs.copy_job(spark, base + "/data", root, "cars", batch_ts="t1")["copied"] == 2
    assert jobs.copy_job(spark, base + "/data", root, "cars", batch_ts="t2")["copied"] == 0
    assert [r.updated_at for r in jobs.record_list(spark, root, "cars").collect()] == ["t1", "t1"]

    for name, doc in (("posts.json", [{"id": "1", "text": "a"}, {"id": "2", "text": "big news"}, {"id": "3", "text": "c"}]),
                      ("map.json", {"1": {"summary": "s", "topic": "t", "tags": ["x"]}}),
                      ("rules.json", [{"name": "News", "keywords": ["news"]}])):
        with open(f"{base}/{name}", "w", encoding="utf-8") as f:
            json.dump(doc, f)
    store = scratch + "/posts"
    jobs.main(["--store", store, "ingest", base + "/posts.json"])
    jobs.main(["--store", store, "enrich", "--enricher", "rules", "--rules", base + "/rules.json", "--limit", "2"])
    rows = {r.id: r for r in jobs.SnapshotStore(spark, store).read().collect()}
    assert rows["2"].topic == "News" and rows["1"].enriched and not rows["3"].enriched
    jobs.main(["--store", store, "enrich", "--force", "--enricher", "mapping", "--answers", base + "/map.json"])
    rows = {r.id: r for r in jobs.SnapshotStore(spark, store).read().collect()}
    assert rows["1"].topic == "t" and rows["3"].enrich_error == E.NO_MAPPING
    jobs.main(["--store", root, "put", "-c", "cars", base + "/posts.json"])
    assert capsys.readouterr().out.splitlines()[-4:-1] == ["1", "2", "3"]
