"""Ordering operators: global positions, listings, top-k, round-robin chunks.

A global position needs the whole order, but never one task: rows are range-
partitioned and sorted, each partition numbers its rows locally, and a table
of per-partition counts (one row per partition — bounded by the partition
count, so safe to broadcast) turns local numbers into global ones.  The
numbered keys are checkpointed into the shared checkpoint folder so that a
lost executor recomputes the same numbering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.core import metric


def _sort_cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def global_position(df: DataFrame, order: Sequence, partitions: int | None = None,
                    name: str = "pos") -> DataFrame:
    """Add a 0-based position of each row in ``order`` (which must be unique).

    Two passes over the checkpointed, range-sorted data; no single-partition
    window.
    """
    spark = df.sparkSession
    n = int(partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    cols = _sort_cols(order)
    numbered = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    # Reliable checkpoint: the numbering must not change if a task is re-run.
    from keepsake.session import scratch_dir
    scratch_dir(spark)
    numbered = numbered.checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def recent_order() -> list[Column]:
    """Most recent first (ISO text, descending), ties in id order."""
    return [F.coalesce(F.col("created_at"), F.lit("")).desc(), F.col("id").asc()]


def metric_order(key: str) -> list[Column]:
    """A metric descending (missing = 0), ties in id order."""
    return [metric("metrics", key).desc(), F.col("id").asc()]


def top_k(df: DataFrame, order: Sequence, k: int, rank_name: str = "rank") -> DataFrame:
    """First ``k`` rows in ``order`` with a 1-based rank.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (each task keeps its
    own k best); ranking the k survivors needs no shuffle of the input.
    """
    if k < 0:
        raise ValueError("limit must be >= 0")
    cols = _sort_cols(order)
    best = df.orderBy(*cols).limit(k)
    return best.withColumn(rank_name, F.row_number().over(Window.orderBy(*cols)).cast("bigint"))


def limit_targets(df: DataFrame, limit: int | None, key: str = "id") -> DataFrame:
    """First ``limit`` rows in key order (limit < 0 is an error, 0 gives none)."""
    if limit is None:
        return df
    if limit < 0:
        raise ValueError("limit must be >= 0")
    return df.orderBy(F.col(key)).limit(limit)


def round_robin_chunks(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Chunk number = (position in key order) mod n, n at least 1."""
    n = max(1, int(n))
    return global_position(df, [key], name="_pos").withColumn(
        "chunk", (F.col("_pos") % n).cast("int")).drop("_pos")
