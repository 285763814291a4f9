from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTS = os.path.join(ROOT, "tests")
sys.path.insert(0, ROOT)
# Python workers unpickle functions defined in test modules: let them import those.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, TESTS, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="keepsake-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("keepsake-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from keepsake.session import scratch_dir

    return scratch_dir(spark)


def post(id_, **kw):
    """A post dict with the given fields (others default via conform)."""
    d = {"id": str(id_), "url": kw.pop("url", f"https://x.com/u/status/{id_}")}
    d.update(kw)
    return d


def posts_df(spark, rows):
    """Conformed posts from a list of dicts."""
    import json

    from pyspark.sql import functions as F

    from keepsake.schema import POST_SCHEMA, conform_posts
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    parsed = lines.select(F.from_json("value", POST_SCHEMA).alias("p")).select("p.*")
    return conform_posts(parsed)
