"""Column helpers and scratch tables shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.session import scratch_dir

#: White space that separates words, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QueryFn = Callable


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words(col: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(text_or_empty(col), BLANKS, -1), "")


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character unchanged.

    A text of one byte per character holds ASCII only; there the fast
    built-in ``lower`` does the same.
    """
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def materialise(df: DataFrame, rows: int | None = None, **options) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: later steps reread the files, so a lost executor never
    recomputes (and never renumbers) what was written.  ``rows``: at most so many in
    an Arrow batch meanwhile, where rows are large; ``options`` are the writer's.
    """
    path = scratch_dir(df.sparkSession)
    with arrow_rows(df.sparkSession, rows):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What runs inside gives Python at most ``rows`` rows at a time (None: the session's number)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is not None:
        spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that they can't clash with an operator's own."""
    return F.struct([F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpack(df: DataFrame, name: str = "row") -> DataFrame:
    fields = df.schema[name].dataType.fieldNames()
    return df.select([F.col(name).getField(c).alias(c) for c in fields])
