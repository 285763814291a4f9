"""URL filter: rules first, then a ratio of two character language models.

URLs that a rule decides are the labelled rows: allowed ones train the model of
accepted URLs, blocked ones that of rejected URLs.  Both are variable-order
Markov models over the characters of host and path: the probability of a
character blends its counts after the last 0 to ``ORDER`` characters (Witten and
Bell's escape weights), so a long context counts as much as it has been seen.
A URL's score is the difference of the two log-likelihoods over its length; it is
blocked above a threshold that is calibrated on labelled URLs kept out of
training (those whose crc32 is divisible by ``HOLD_OUT``).

Characters fall into 32 classes (letters by A-Z case folding, one for digits,
``.``, ``/``, ``-``, one for the rest, one for the start), so the table of blended
ratios has 32**(ORDER+1) numbers at any size of the corpus.  The counts below it
cover every labelled URL and are summed inside each task before they are
exchanged.  Because of that proven bound (one float per number, 4 MB) the table
reaches the tasks as one scalar value and scoring a URL needs no exchange.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, scores 0 and is allowed; repeated rows are judged one by one; if
either class has no labelled URL, every other URL is allowed; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import UPPER, text_or_empty

#: Longest context in characters.
ORDER = 3
CLASSES = 32
#: Labelled URLs whose crc32 has this remainder of 0 calibrate the threshold.
HOLD_OUT = 5
#: Width of the score bins of the calibration.
BIN = 0.02

#: The rules (verdict, host, path), as the contract states them.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    text = text_or_empty(url)
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def char_classes(text: Column) -> Column:
    """The classes (1 to 31) of a text's characters, as an array."""
    low = F.translate(text, UPPER, UPPER.lower())
    plain = F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), r"[^a-z0./-]", "_")
    alphabet = "abcdefghijklmnopqrstuvwxyz0./-_"
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.instr(F.lit(alphabet), c))


def windows(classes: Column) -> Column:
    """Each character with its ORDER predecessors, as one number in base CLASSES (0: before the start)."""
    def push(acc, c):
        w = (acc["w"] * CLASSES + c) % (CLASSES ** (ORDER + 1))
        return F.struct(w.alias("w"), F.concat(acc["out"], F.array(w)).alias("out"))
    start = F.struct(F.lit(0).alias("w"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(classes, start, push, lambda acc: acc["out"])


def ratio_table(labelled: DataFrame) -> DataFrame:
    """From rows (codes: windows, bad: boolean) one row: the array of blended log ratios by window."""
    spark = labelled.sparkSession
    one = (labelled.select("bad", F.explode("codes").alias("w")).groupBy("w")
           .agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).cast("double").alias("b"),
                F.sum(F.when(F.col("bad"), 0).otherwise(1)).cast("double").alias("g")))
    level = None
    for order in range(ORDER + 1):
        size = CLASSES ** (order + 1)
        seen = one.groupBy((F.col("w") % size).alias("w")).agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
        context = seen.groupBy(F.floor(F.col("w") / CLASSES).cast("int").alias("ctx")).agg(
            F.sum("b").alias("nb"), F.sum("g").alias("ng"),
            F.sum((F.col("b") > 0).cast("double")).alias("kb"), F.sum((F.col("g") > 0).cast("double")).alias("kg"))
        cells = (spark.range(size).select(F.col("id").cast("int").alias("w"))
                 .withColumn("ctx", F.floor(F.col("w") / CLASSES).cast("int"))
                 .join(seen, "w", "left").join(context, "ctx", "left").na.fill(0.0, ["b", "g", "nb", "ng", "kb", "kg"]))
        if level is None:
            cells = cells.withColumn("pb", F.lit(1.0 / CLASSES)).withColumn("pg", F.lit(1.0 / CLASSES))
        else:
            shorter = level.select(F.col("w").alias("suffix"), F.col("pb"), F.col("pg"))
            cells = cells.withColumn("suffix", F.col("w") % (size // CLASSES)).join(shorter, "suffix")

        def blend(n, total, kinds, lower):
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(lower)) / (F.col(total) + F.col(kinds))
                          ).otherwise(F.col(lower))
        level = cells.select("w", blend("b", "nb", "kb", "pb").alias("pb"), blend("g", "ng", "kg", "pg").alias("pg"))
    ratio = F.struct("w", (F.ln("pb") - F.ln("pg")).cast("float").alias("x"))
    return level.agg(F.transform(F.sort_array(F.collect_list(ratio)), lambda c: c["x"]).alias("ratios"))


def mean_ratio(codes: Column, ratios: Column) -> Column:
    """Log-likelihood difference over the length; positive: like rejected URLs."""
    total = F.aggregate(codes, F.lit(0.0), lambda acc, w: acc + F.get(ratios, w))
    return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the middle of the gap with the least balanced error on rows (score, bad); the first of equals.

    Null when either kind of row is missing.  Scores are bounded by the log
    ratios, so there are at most some thousand bins.
    """
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("g"))
    rows = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "b", "g"))).alias("bins"),
                    F.sum("b").alias("nb"), F.sum("g").alias("ng"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("g"),
                     F.lit(None).cast("long").alias("last"), F.lit(1.0).alias("err"), F.lit(0.0).alias("cut"))

    def step(acc, x):  # tries the gap before x
        err = acc["b"] / F.col("nb") + 1 - acc["g"] / F.col("ng")
        win = acc["last"].isNotNull() & (err < acc["err"])
        cut = (acc["last"] + 1 + x["bin"]) * (BIN / 2)
        return F.struct((acc["b"] + x["b"]).alias("b"), (acc["g"] + x["g"]).alias("g"), x["bin"].alias("last"),
                        F.when(win, err).otherwise(acc["err"]).alias("err"),
                        F.when(win, cut).otherwise(acc["cut"]).alias("cut"))

    best = F.aggregate("bins", start, step)["cut"]
    return rows.select(F.when((F.col("nb") > 0) & (F.col("ng") > 0), best).alias("cut"))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with a struct column ``judged``: host, path, rule, verdict, score."""
    host, path = host_and_path(F.col(f"`{url_col}`"))

    def parsed(df: DataFrame, keep: list[Column]) -> DataFrame:
        out = df.select(*keep, host.alias("host"), path.alias("path"))
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return out.select(*[c for c in out.columns], rule.alias("rule"), verdict.alias("ruled"),
                          windows(char_classes(F.concat("host", "path"))).alias("codes"))

    known = parsed(pages, []).filter("rule is not null and size(codes) > 0").withColumn("bad", F.col("ruled") == "block")
    held = F.crc32(F.concat("host", "path").cast("binary")) % HOLD_OUT == 0
    ratios = ratio_table(known.filter(~held)).select("ratios").scalar()


    def scores(df: DataFrame) -> DataFrame:
        # The optimizer folds the table's column into the score: rows don't carry it.
        out = df.withColumn("ratios", ratios).withColumn("score", mean_ratio(F.col("codes"), F.col("ratios")))
        return out.drop("ratios")

    cut = threshold(scores(known.filter(held)).select("bad", "score")).select("cut").scalar()
    row = F.struct([F.col(f"`{c}`") for c in pages.columns]).alias("row")
    scored = scores(parsed(pages, [row])).withColumn("cut", cut)
    learned = F.when(F.col("score") > F.col("cut"), "block").otherwise("allow")
    judged = F.struct("host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score").alias("judged")
    names = [c for c in pages.columns if c != "judged"]
    return scored.select(*[F.col("row").getField(c).alias(c) for c in names], judged)
