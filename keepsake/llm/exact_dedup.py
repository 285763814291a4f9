"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition becomes one run: its rows' digests, sorted and written
once to the shared folder.  Runs then merge in rounds, ``fan_in`` neighbours at
a time, until one run (spread over all tasks by digest) is left.  A merge keeps,
for each digest, the identifier that stays and the number of rows; both are
reduced inside every task before rows are exchanged, so a text that fills a
third of the corpus travels once per run.  Digests count as equal only if the
byte length and a second, independent hash agree as well.

The answer goes back the same way: once per (run, digest), then to the rows of
that run.  No join key gathers more rows than one run holds.

Defined results: a null text counts as empty; equal rows of one ``doc_id`` are
ordered by their position, so exactly one row of each group stays; a null
``doc_id`` is smaller than any other; an empty table gives no rows; further
columns of any name pass through ``drop_copies`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import lower_ascii, materialise, text_or_empty

KEYS = ["digest", "n_bytes", "check"]
#: Runs that one merge takes in.
FAN_IN = 16


def with_digest(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the digest columns of the lower-cased text (A-Z only)."""
    norm = lower_ascii(text_or_empty(F.col(text_col)))
    return (docs.withColumn("norm", norm)
            .withColumn("digest", F.unhex(F.sha2("norm", 256)))
            .withColumn("n_bytes", F.octet_length("norm"))
            .withColumn("check", F.xxhash64("norm"))
            .drop("norm"))


def sorted_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One sorted run of (doc_id, pos, digest) per partition, written once."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = (with_digest(cols, "text").drop("text")
            .withColumn("run", F.spark_partition_id().cast("long"))
            .withColumn("pos", F.monotonically_increasing_id())
            .sortWithinPartitions(*KEYS))
    return materialise(runs)


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(heads of each run, the last run): per digest the row that stays and the row count."""
    best = F.max(F.struct("doc_id", "pos")).alias("best")
    heads = runs.groupBy("run", *KEYS).agg(best, F.count(F.lit(1)).alias("n_rows"))
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    merged = heads
    while left > 1:
        merged = (merged.withColumn("run", F.floor(F.col("run") / fan_in))
                  .groupBy("run", *KEYS)
                  .agg(F.max("best").alias("best"), F.sum("n_rows").alias("n_rows")))
        left = -(-left // fan_in)
    return heads, merged.drop("run")


def judged_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's digest with its group: doc_id, pos, keep_id, group_size, kept."""
    runs = sorted_runs(docs, id_col, text_col)
    heads, merged = merge_runs(runs)
    answers = heads.select("run", *KEYS).join(merged, KEYS)
    return (runs.join(answers, ["run", *KEYS])
            .withColumn("keep_id", F.col("best.doc_id"))
            .withColumn("group_size", F.col("n_rows"))
            .withColumn("kept", F.col("pos") == F.col("best.pos")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return judged_runs(docs, id_col, text_col).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a larger id replaces.

    Rows that repeat both id and text can't be told apart by those; of such
    a set the row with the largest remaining columns stays.
    """
    names = docs.columns
    winners = materialise(
        judged_runs(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(*KEYS, "keep_id").agg(F.count(F.lit(1)).alias("same")))
    row = F.struct([F.col(f"`{c}`") for c in names])
    cols = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"),
                       F.col(f"`{text_col}`").alias("own_text"))
    rows = with_digest(cols, "own_text").drop("own_text")

    def of(sel: DataFrame) -> DataFrame:
        w = sel.select(*[F.col(k).alias(f"w_{k}") for k in KEYS], "keep_id")
        same = F.col("own_id").eqNullSafe(F.col("keep_id"))
        for k in KEYS:
            same = same & (F.col(k) == F.col(f"w_{k}"))
        return rows.join(w, same, "left_semi")

    out = of(winners.filter("same = 1")).select("row")
    again = winners.filter("same > 1")
    if not again.isEmpty():
        sortable = F.to_json("row")
        out = out.unionByName(of(again).groupBy(*KEYS).agg(F.max_by("row", sortable).alias("row"))
                              .select("row"))
    return out.select([F.col("row").getField(c).alias(c) for c in names])
