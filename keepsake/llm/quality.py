"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured once.  Documents that fail the base rules go; over the
others each measure gets a quantile sketch per language and source: counts of
log-linear buckets (values below 64 exactly, above within 1/32), which merge by
adding and so combine inside each task, between tasks and from sources to
languages to the whole corpus with one result in any order.  From a sketch's
quartiles come fences (quartile -/+ ``REACH`` times the quartile distance and a
fixed slack); a group with fewer than ``LEAST`` documents uses the merged sketch
of its language, and a language with fewer that of the corpus.  Thresholds are then
joined to the documents by language and source.

The thresholds are written to the shared folder, so that Spark knows their size:
it broadcasts them below its own limit, else it joins by shuffling and splits
the hot source.

Defined results: a null text is empty (no words: it fails the base rules); null
languages and sources are groups of their own; repeated rows are judged one by
one and counted each; an empty table gives no rows; further columns of any
name pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import materialise, text_or_empty, words

MIN_WORDS = 50
#: Base rule: at most this percentage of a text's words in repeated 3-word windows.
MAX_REPEAT = 50
SYMBOLS = "[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"
REACH = 3
LEAST = 50
#: Measure -> (slack below the lower fence or None, slack above the upper fence), in its unit.
MEASURES = {
    "symbol_rate": (None, 100),    # symbols per 1000 words
    "dup_line_rate": (None, 400),  # repeated lines per 1000 lines
    "repeat_rate": (None, 400),    # words in repeated windows per 1000 words
    "word_length": (40, 40),       # code points per 100 words
}


def measured(df: DataFrame, text: Column) -> DataFrame:
    """Adds the base counts of ``text``, the rates and ``base_failed``.

    Repeated windows are found by sorting a text's 3-word windows, only where
    hashes show that some window may be repeated.
    """
    raw = df.withColumn("_t", text_or_empty(text)).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(A_WORD))
    symbols = F.char_length("_t") - F.char_length(F.regexp_replace("_t", SYMBOLS, ""))
    n = F.size("_w")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    counted = (raw.withColumn("_l", lines)
               .withColumn("n_words", n.cast("long"))
               .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
               .withColumn("n_symbols", symbols.cast("long")).drop("_t")
               .withColumn("n_lines", F.size("_l").cast("long"))
               .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
               .withColumn("_at", at))
    word = lambda i: F.get("_w", i)
    hashed = counted.withColumn("_h", F.transform("_at", lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    may_repeat = F.size(F.array_distinct("_h")) < F.size("_h")
    windows = F.sort_array(F.transform("_at", lambda i: F.struct(
        F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:string,i:int>>")
    windowed = hashed.withColumn("_s", F.when(may_repeat, windows).otherwise(none)).drop("_w", "_at", "_h")

    def repeated(x, k):
        return F.when((x["g"] == F.get("_s", k - 1)["g"]) | (x["g"] == F.get("_s", k + 1)["g"]), x["i"]).otherwise(-1)
    hits = F.sort_array(F.filter(F.transform("_s", repeated), lambda i: i >= 0))

    def cover(acc, i):
        return F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end"))
    covered = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    out = windowed.withColumn("n_repeat_words", covered.cast("long")).drop("_s")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")
    return (out.withColumn("base_failed", failed)
            .withColumn("symbol_rate", F.expr("try_divide(1000 * n_symbols, n_words)").cast("long"))
            .withColumn("dup_line_rate", F.expr("try_divide(1000 * n_dup_lines, n_lines)").cast("long"))
            .withColumn("repeat_rate", F.expr("try_divide(1000 * n_repeat_words, n_words)").cast("long"))
            .withColumn("word_length", F.expr("try_divide(100 * word_chars, n_words)").cast("long")))


def bucket(v: str) -> Column:
    """The lower end of a value's log-linear bucket."""
    return F.expr(f"case when {v} < 64 then {v} else shiftleft(shiftright({v}, length(bin({v})) - 6), "
                  f"length(bin({v})) - 6) end")


def sketches(rows: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, measure, bucket, n) over the documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])
    # not a filter: pushed down, it would repeat the measuring inside its own loops
    each = F.explode(F.when(F.col("base_failed"), F.slice(each, 1, 0)).otherwise(each))
    return (rows.select("lang", "source", each.alias("x"))
            .select("lang", "source", "x.measure", F.expr("x.v").alias("v")).withColumn("bucket", bucket("v"))
            .groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n")))


def fences(sketch: DataFrame, level: list[str]) -> DataFrame:
    """Merges sketches to a level; one row per group with each measure's fences and ``n_docs``."""
    merged = sketch.groupBy(*level, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*level, "measure")
    up_to = F.sum("n").over(group.orderBy("bucket"))
    ranked = merged.withColumn("n_docs", F.sum("n").over(group)).withColumn("up_to", up_to)

    def quartile(p):
        return F.min(F.when(F.col("up_to") * 100 >= p * F.col("n_docs"), F.col("bucket")))
    q = ranked.groupBy(*level, "measure").agg(quartile(25).alias("q1"), quartile(75).alias("q3"),
                                              F.max("n_docs").alias("n_docs"))
    spread = REACH * (F.col("q3") - F.col("q1"))
    sides = []
    for m, (low, high) in MEASURES.items():
        here = F.col("measure") == m
        sides.append(F.max(F.when(here, F.col("q3") + spread + high)).alias(f"{m}_max"))
        if low is not None:
            sides.append(F.max(F.when(here, F.col("q1") - spread - low)).alias(f"{m}_min"))
    return q.groupBy(*level).agg(*sides, F.max("n_docs").alias("n_docs"))


def _sides() -> list[str]:
    return [f"{m}_{side}" for m, (low, _) in MEASURES.items() for side in (["max"] if low is None else ["max", "min"])]


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per (lang, source) with the fences of the finest level that has ``LEAST`` documents; written once."""
    sketch = materialise(sketches(rows))
    fine = fences(sketch, ["lang", "source"])
    by_lang = fences(sketch, ["lang"])
    # one row: a scalar per fence
    whole = fences(sketch.withColumn("all", F.lit(1)), ["all"])
    lang = by_lang.select(F.col("lang").alias("l_lang"), F.col("n_docs").alias("l_n"),
                          *[F.col(s).alias(f"l_{s}") for s in _sides()])
    both = fine.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    picked = [F.when(F.col("n_docs") >= LEAST, F.col(s)).when(F.col("l_n") >= LEAST, F.col(f"l_{s}"))
              .otherwise(whole.select(s).scalar()).alias(s) for s in _sides()]
    return materialise(both.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *picked))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measured rows joined with their group's thresholds; adds ``kept``."""
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    good = F.lit(True)
    for m, (low, _) in MEASURES.items():
        good = good & (F.col(m) <= F.col(f"{m}_max"))
        if low is not None:
            good = good & (F.col(m) >= F.col(f"{m}_min"))
    return (rows.join(limits, same, "left")
            .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(good, F.lit(True))))
            .drop("t_lang", "t_source"))


def _keyed(docs: DataFrame, keep: list[Column], lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*keep, F.col(f"`{lang_col}`").cast("string").alias("lang"),
                       F.col(f"`{source_col}`").cast("string").alias("source"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """One row per document: id, base counts, base_failed, kept, rates and the thresholds applied."""
    keep = [F.col(f"`{id_col}`").alias("uid"), F.col(f"`{text_col}`").alias("txt")]
    rows = materialise(measured(_keyed(docs, keep, lang_col, source_col), F.col("txt")).drop("txt"))
    out = judged(rows, thresholds(rows)).withColumnRenamed("uid", id_col)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", *MEASURES, *_sides())


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are measured twice, once for the sketches and once for the join,
    instead of being written or shuffled in between.
    """
    names = docs.columns
    row = F.struct([F.col(f"`{c}`") for c in names]).alias("row")
    rows = measured(_keyed(docs, [row], lang_col, source_col), F.col("row").getField(text_col))
    out = judged(rows, thresholds(rows.drop("row"))).filter("kept")
    return out.select([F.col("row").getField(c).alias(c) for c in names])
