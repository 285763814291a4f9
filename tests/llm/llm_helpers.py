"""Fixtures and small helpers for the corpus operators' tests."""

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    """docs(rows): a documents table from (doc_id, text[, lang, source]) tuples."""
    def make(rows):
        full = []
        for r in rows:
            i, t, lang, source = (*r, *("en", "s")[len(r) - 2:])[:4]
            full.append((i, t, lang, source, len(t) if t is not None else None))
        return spark.createDataFrame(full, DOC_SCHEMA)
    return make
