"""Mixing sources to target weights with Sainte-Laguë quotas of equal-token blocks.

Sources share ``share`` times all words by weight; a source's target stops at
``cap`` times its words and the excess goes to the others by weight.  The total
is cut into blocks of ``block`` words, and blocks are seats: sources, then regions
of a source, then shards of a region get integer quotas by the highest quotients
votes/1, votes/3, votes/5 ...  Within a shard, whole passes over its words come
first; the rest of its quota is a seeded choice of its blocks, the last one cut to
the words that remain.

Only quotients near the divisor are ranked: with m parties and N seats every
quota lies between the rounded shares at the divisors V/(N-m) and V/(N+m), so at
most about 5m quotients decide, however many seats there are.  Shards hold about
``shard_words`` words and are hashed from the document ids, regions are the square
root of their number, so no window or join key of the plan gathers more than
that, whatever a source's share of the corpus.

Defined results: a null text has no words; a null source is a source of its own
and comes last; documents without words take nothing; equal rows are told apart
by nothing and share their choice as a set; an empty table gives no rows; further
columns of any name pass through ``mixed_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import materialise, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK = 32
SHARD_WORDS = 16384
SEED = 2654435761


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` (double) to one row per source (source, source_size).

    Filling up: with sources sorted by cap * size / weight, the level of the
    uncapped ones is the largest of the levels that result when each prefix is
    capped.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (sizes.withColumn("weight", F.get(choice, (F.row_number().over(by_name) - 1) % len(weights)))
               .withColumn("most", cap * F.col("source_size"))
               .withColumn("total", share * F.sum("source_size").over(every)))
    fill = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (weighed.withColumn("level", level).withColumn("level", F.max("level").over(every))
            .withColumn("target", F.least(F.col("most"), F.col("level") * F.col("weight")))
            .drop("most", "total", "level"))


def sainte_lague(parties: DataFrame, parent: list[str], party: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the party's share of its parent's ``seats`` by highest quotients (ties: smaller party)."""
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    n = F.col(seats).cast("double")
    near = (parties.withColumn("_v", F.col(votes).cast("double"))
            .withColumn("_all", F.sum("_v").over(group)).withColumn("_m", F.count(F.lit(1)).over(group))
            .withColumn("_low", F.when((F.col("_all") > 0) & (n > F.col("_m")), F.greatest(F.lit(0), F.floor(
                F.col("_v") * (n - F.col("_m")) / F.col("_all") - 0.5))).otherwise(F.lit(0)).cast("long"))
            .withColumn("_high", F.when(F.col("_v") > 0, F.floor(
                F.col("_v") * (n + F.col("_m")) / F.col("_all") + 1.5)).otherwise(F.col("_low")).cast("long"))
            .withColumn("_left", n - F.sum("_low").over(group)))
    ranked = (near.withColumn("_k", F.explode(F.sequence("_low", F.greatest("_low", F.col("_high")))))
              .withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1))
              .withColumn("_rank", F.row_number().over(
                  group.orderBy(F.desc("_q"), F.col(party).asc_nulls_last(), "_k"))))
    won = ((F.col("_rank") <= F.col("_left")) & (F.col("_v") > 0)).cast("long")
    keep = parties.columns
    return (ranked.groupBy(*keep, "_low").agg(F.sum(won).alias("_won"))
            .withColumn(out, F.col("_low") + F.col("_won")).drop("_low", "_won"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Adds the size in words and the seeded hashes that place a document."""
    uid = F.col(f"`{id_col}`")
    return (docs.withColumn("source", F.col(f"`{source_col}`"))
            .withColumn("size", F.size(words(F.col(f"`{text_col}`"))).cast("long"))
            .withColumn("tie", F.xxhash64(F.col(f"`{text_col}`")))
            .withColumn("h1", F.xxhash64(uid, F.lit(seed))).withColumn("h2", F.xxhash64(uid, F.lit(seed + 1)))
            .withColumn("h3", F.xxhash64(uid, F.lit(seed + 2))))


def source_table(sizes: DataFrame, block: int, shard_words: int) -> DataFrame:
    """One row per source: size, target, seats, regions and shards per region; written once."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(per_source).withColumn("all_seats", F.round(
        F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    seated = sainte_lague(t, [], "source", "target", "all_seats", "seats")
    n = F.ceil(F.col("source_size") / shard_words)
    return materialise(seated.withColumn("n_regions", F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long"))
                       .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(n / F.col("n_regions"))).cast("long"))
                       .drop("all_seats", "weight"))


PLACE = ["source_no", "region", "shard"]


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures and their region and shard.

    The table of sources has a known file size: Spark broadcasts it below its
    own limit, else joins by shuffling and splits a hot source.
    """
    s = sources.select(F.col("source").alias("s"), F.xxhash64("source").alias("source_no"), "source_size", "target",
                       "seats", "n_regions", "n_shards")
    return (rows.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("region", F.pmod("h1", "n_regions")).withColumn("shard", F.pmod("h2", "n_shards")))


def shard_quotas(sizes: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """One row per shard: ``passes`` over all its words and ``take``, the words of each block in the last pass."""
    shards = (placed(sizes, sources).groupBy("source", *PLACE, "seats").agg(F.sum("size").alias("n_words")))
    regions = shards.groupBy("source", "source_no", "region", "seats").agg(F.sum("n_words").alias("region_words"))
    regions = sainte_lague(regions, ["source"], "region", "region_words", "seats", "region_seats")
    r = regions.select(F.col("source_no").alias("r_no"), F.col("source").alias("r_source"), F.col("region").alias("r_region"),
                       "region_seats")
    shards = shards.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("region") == F.col("r_region"))
                         ).drop("r_no", "r_source", "r_region")
    quota = sainte_lague(shards, ["source", "region"], "shard", "n_words", "region_seats", "quota")
    wanted = F.least(F.col("quota") * block, F.round(CAP * F.col("n_words")).cast("long"))
    plan = (quota.filter("n_words > 0").withColumn("wanted", wanted)
            .withColumn("passes", F.floor(F.col("wanted") / F.col("n_words")))
            .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("n_words"))
            .withColumn("whole", F.floor(F.col("n_words") / block))
            .withColumn("picked", F.floor(F.col("rest") / block))
            .withColumn("last", F.col("rest") - F.col("picked") * block))
    blocks = F.when(F.col("whole") > 0, F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)
                    ).otherwise(F.array().cast("array<long>"))
    order = F.array_sort(F.transform(blocks, lambda b: F.struct(
        F.xxhash64(*PLACE, b, F.lit(seed)).alias("h"), b.alias("b"))))
    by_block = F.array_sort(F.transform(order, lambda x, i: F.struct(x["b"].alias("b"), i.alias("rank"))))
    take = F.transform(by_block, lambda x: F.when(x["rank"] < F.col("picked"), F.lit(block))
                       .when(x["rank"] == F.col("picked"), F.col("last")).otherwise(F.lit(0)).cast("int"))
    tail = F.when(F.col("picked") == F.col("whole"), F.col("last")).otherwise(F.lit(0)).cast("int")
    return plan.select("source", *PLACE, "passes", F.concat(take, F.array(tail)).alias("take"))


def taken_words(start: Column, size: Column, take: Column, block: int) -> Column:
    """Words of the last pass in a document that occupies [start, start + size) of its shard."""
    end = start + size

    def add(acc, b):
        first = b * block
        n = F.least(end, first + F.get(take, b.cast("int"))) - F.greatest(start, first)
        return acc + F.greatest(n, F.lit(0).cast("long"))
    span = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    return F.when(size > 0, F.aggregate(span, F.lit(0).cast("long"), add)).otherwise(F.lit(0).cast("long"))


def planned(rows: DataFrame, sources: DataFrame, quotas: DataFrame, block: int) -> DataFrame:
    """Rows with ``start`` in their shard, ``passes``, ``take``, ``part`` (words of the last pass) and ``taken``."""
    at = Window.partitionBy("source", *PLACE).orderBy("h3", "uid", "size", "tie")
    laid = placed(rows, sources).withColumn(
        "start", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    q = quotas.select(F.col("source").alias("q_source"), *[F.col(c).alias(f"q_{c}") for c in PLACE], "passes", "take")
    same = F.col("source").eqNullSafe(F.col("q_source"))
    for c in PLACE:
        same = same & (F.col(c) == F.col(f"q_{c}"))
    joined = laid.join(q, same, "left")
    part = F.when(F.col("take").isNotNull(), taken_words(F.col("start"), F.col("size"), F.col("take"), block))
    return (joined.withColumn("passes", F.coalesce("passes", F.lit(0).cast("long")))
            .withColumn("part", F.coalesce(part, F.lit(0).cast("long")))
            .withColumn("taken", F.col("passes") * F.col("size") + F.col("part")))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    cols = docs.select(F.col(f"`{id_col}`").alias("uid"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{source_col}`").alias("source"))
    rows = materialise(sized(cols, "uid", "text", "source", seed).drop("text"))
    sources = source_table(rows, block, shard_words)
    quotas = shard_quotas(rows, sources, block, seed)
    return planned(rows, sources, quotas, block).select(
        F.col("uid").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    n_chars_col: str = "n_chars", block: int = BLOCK, shard_words: int = SHARD_WORDS,
                    seed: int = SEED) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each pass takes the whole text, the last one its chosen words.

    Words are counted in a first pass that writes sizes only; the texts move
    once, to their shards.
    """
    names = docs.columns
    row = F.struct([F.col(f"`{c}`") for c in names]).alias("row")
    cols = docs.select(row, F.col(f"`{id_col}`").alias("uid"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{source_col}`").alias("source"))
    rows = sized(cols, "uid", "text", "source", seed).drop("text")
    sizes = materialise(rows.select("source", "size", "h1", "h2"))
    sources = source_table(sizes, block, shard_words)
    quotas = materialise(shard_quotas(sizes, sources, block, seed))
    plan = planned(rows, sources, quotas, block).filter("taken > 0")
    text = F.col("row").getField(text_col)
    picked = F.filter(words(text), lambda w, i: ((F.col("start") + i) % block) < F.get(
        F.col("take"), F.floor((F.col("start") + i) / block).cast("int")))
    part = (F.when(F.col("part") == 0, F.array().cast("array<string>"))
            .when(F.col("part") == F.col("size"), F.array(text)).otherwise(F.array(F.array_join(picked, " "))))
    out = plan.select("row", F.explode(F.concat(F.array_repeat(text, F.col("passes").cast("int")), part)).alias("piece"))

    def column(c):
        if c == text_col:
            return F.col("piece").alias(c)
        if c == n_chars_col:
            return F.char_length("piece").cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)
    return out.select([column(c) for c in names])
