"""Plan shape checks and the driver contract."""

from __future__ import annotations

import contextlib
import io

import __spark_entry__ as se
from conftest import SF_SMALL, post, posts_df
from keepsake.functions.rulesets import DEFAULT_CATEGORIES
from keepsake.operators import merge
from keepsake.operators import rules as R


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_rule_scoring_is_a_projection(spark):
    p = posts_df(spark, [post(1, text="python")])
    text = plan_text(R.categorize(p, DEFAULT_CATEGORIES))
    assert "Exchange" not in text and "NestedLoopJoin" not in text
    assert "PythonUDF" not in text and "ArrowEval" not in text


def test_additive_ingest_no_cartesian(spark):
    store = posts_df(spark, [post(1)])
    inc = posts_df(spark, [post(2)]).selectExpr("*", "0 AS batch", "0 AS pos")
    merged, _ = merge.ingest_additive(store, inc, ["batch", "pos"])
    text = plan_text(merged)
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_contract_keys():
    qs, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
    from keepsake.plans.queries import QUERIES

    for name in QUERIES:  # "pipeline" is the corpus pipeline's name
        assert "pipeline" not in name


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["tag", "id", "line"] and df.count() > 0


def test_small_sf_queries_have_rows(spark):
    qs = se.queries()
    for name in ("catalog_lines", "ingest_additive", "rule_enrich", "normalize_posts", "scan_records"):
        assert qs[name](spark, SF_SMALL).count() > 0, name
