"""Session helpers: a test/bench session and the shared scratch location.

On a cluster the scratch area is whatever ``spark.checkpoint.dir`` names (a
shared filesystem).  Only when nothing is configured — local runs and tests —
do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "keepsake") -> SparkSession:
    """A session tuned for this library; cluster deployments pass their own conf."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = partitions or cpus
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KEEPSAKE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def _checkpoint_root(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    root = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if root:
            sc.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh directory under the shared checkpoint location.

    Reads ``spark.checkpoint.dir`` from the session.  When it is unset and the
    master is local (tests, benches) a private directory is created and set as
    the checkpoint dir; on a cluster an unset value is an error, because a
    machine-local folder is not visible to executors.
    """
    global _LOCAL_SCRATCH
    root = _checkpoint_root(spark)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        if _LOCAL_SCRATCH is None:
            _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="keepsake-")
        root = _LOCAL_SCRATCH
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    sub = name or uuid.uuid4().hex
    return root.rstrip("/") + "/keepsake-scratch/" + sub


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once: written to the shared scratch folder and read back.

    Later steps reread the files, so a lost executor never recomputes (or renumbers) what was written.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``keepsake`` importable on executors (once per session).

    Operators that run Python on executors (the payload UDTF, ``mapInPandas``
    plug-ins) pickle functions by reference to this package; the package is
    zipped into the shared scratch area and added with ``addPyFile``.  A
    deployment that already ships it (``--py-files``) can set
    ``spark.keepsake.shipped=true`` to skip this.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or spark.conf.get("spark.keepsake.shipped", "false") == "true":
        return
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = scratch_dir(spark, "pkg-" + uuid.uuid4().hex) + "/keepsake.zip"
    path = target[len("file:"):] if target.startswith("file:") else target
    if "://" in path:
        # Shared non-local filesystem: write through the Hadoop client API.
        jvm = sc._jvm
        p = jvm.org.apache.hadoop.fs.Path(target)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(p)
        out.write(bytearray(buf.getvalue()))
        out.close()
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(key)
