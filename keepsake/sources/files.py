"""File readers shared by the format sources.

Whole-file JSON documents are not splittable: each file is one row
``(file_ord, path, value)``.  ``file_ord`` is the arrival order of the files
(position in the given list, then path order inside a directory), which the
first/last-wins rules need; it never comes from ``monotonically_increasing_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def whole_files(spark: SparkSession, paths: str | Sequence[str], below: int | None = None) -> DataFrame:
    """(file_ord, path, value): one row per file, of files of fewer than ``below`` bytes if that is given.

    ``file_ord`` is the position of the given path in ``paths``; files found
    under one directory/glob share it and are ordered by ``path`` — so the
    arrival order of a file is the pair (file_ord, path).
    """
    frames = []
    for i, p in enumerate(path_list(paths)):
        df = spark.read.text(p, wholetext=True)
        if below is not None:
            df = df.where(F.col("_metadata.file_size") < below)
        frames.append(df.select(F.lit(i).cast("bigint").alias("file_ord"),
                                F.col("_metadata.file_path").alias("path"), "value"))
    return reduce(DataFrame.unionByName, frames)


FILE_ORDER = ("file_ord", "path")
LINE_ORDER = ("file_ord", "path", "block", "line_no")


def line_order(raw: DataFrame) -> list[str]:
    """The columns of :data:`LINE_ORDER` that lines from another reader have."""
    return [c for c in LINE_ORDER if c in raw.columns]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, asked of the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file_ord, path, block, line_no, value) for newline-delimited files, split on
    ``\\n`` only — U+2028/U+2029/NEL inside JSON strings stay in the record.

    Splittable: each block is read by its own task; :data:`LINE_ORDER`
    orders the lines exactly, files in the given order.  A path that doesn't
    exist has no lines: a store that was never written is empty.
    """
    frames = []
    for i, p in enumerate(path_list(paths)):
        if path_exists(spark, p):
            df = spark.read.option("lineSep", "\n").text(p)
            frames.append(df.select(F.lit(i).cast("bigint").alias("file_ord"),
                                    F.col("_metadata.file_path").alias("path"),
                                    F.col("_metadata.file_block_start").alias("block"),
                                    F.monotonically_increasing_id().alias("line_no"), "value"))
    if not frames:
        return spark.createDataFrame([], "file_ord bigint, path string, block bigint, line_no bigint, value string")
    return reduce(DataFrame.unionByName, frames)
