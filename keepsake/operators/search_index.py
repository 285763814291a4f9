"""All-token text search over stored trigrams, so that a query reads few posts.

``write_index`` stores the posts in ``buckets`` directories by a hash of the id, with a
number each, and beside them postings: for each distinct trigram of a block of posts'
haystacks a row (gram, bucket, numbers) of the posts that hold it, sorted by gram over
range-partitioned files.  A query's tokens hold trigrams,
all of which a match must hold: the postings of those few grams are read (files and
row groups of other grams are skipped by their statistics), posts that have all of
them are candidates, only the candidates' buckets of posts are read, and ``contains``
decides on the whole haystack.  A token shorter than a trigram says nothing; a query
of such tokens alone reads all posts.

A common trigram's postings spread over several rows and files and are counted where they
are read; what meets by (bucket, number) is one count per post and task.  Numbers are of
stored posts, so none changes afterwards.

Defined results: as ``operators.search.search``; posts that repeat an id are each
judged by their own text; an empty query returns all posts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.core import search_haystack
from keepsake.operators.search import match_tag, match_text, query_tokens
from keepsake.session import ship_package, written

GRAM = 3
#: Directories that posts are stored in.
BUCKETS = 64
#: Postings that are made together.
BLOCK = 1_000_000
#: Column of the stored posts' numbers.
NUMBER = "_number"


def query_grams(q: str | None) -> list[str]:
    """The distinct trigrams of a query's tokens."""
    return sorted({t[k:k + GRAM] for t in query_tokens(q) for k in range(len(t) - GRAM + 1)})


def _block(code: np.ndarray, bucket: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """(gram, bucket, numbers) of (gram code, bucket, post number)."""
    order = np.lexsort((number, bucket, code))
    code, bucket, number = code[order], bucket[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])]))
    chars = np.stack([code[first] >> 42, (code[first] >> 21) & 0x1FFFFF, code[first] & 0x1FFFFF], 1).astype("<u4")
    text = chars.tobytes().decode("utf-32-le")
    numbers = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(number, pa.int64()))
    grams = pa.array([text[k:k + GRAM] for k in range(0, len(text), GRAM)], pa.string())
    return pa.RecordBatch.from_arrays([grams, pa.array(bucket[first], pa.int32()), numbers], names=["gram", "bucket", "numbers"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, bucket, numbers) of posts (bucket, number, hay), about ``BLOCK`` postings at a time."""
    held, size = [], 0
    for b in batches:
        for bucket, number, hay in zip(*(b.column(c) for c in ("bucket", "number", "hay"))):
            c = np.frombuffer(hay.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
            if len(c) >= GRAM:  # a character has 21 bits: three are one number
                code = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
                held.append((code, np.full(len(code), bucket.as_py()), np.full(len(code), number.as_py())))
                size += len(code)
            if size >= BLOCK:
                yield _block(*map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield _block(*map(np.concatenate, zip(*held)))


def write_index(posts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store posts and their postings under ``path`` (which must not exist)."""
    ship_package(posts.sparkSession)
    placed = posts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    ranged = placed.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    ranged.withColumn(NUMBER, F.monotonically_increasing_id()).write.partitionBy("bucket").parquet(path + "/posts")
    stored = posts.sparkSession.read.parquet(path + "/posts").select(
        F.col("bucket").cast("int").alias("bucket"), F.col(NUMBER).alias("number"), search_haystack().alias("hay"))
    postings = written(stored.mapInArrow(_postings, "gram string, bucket int, numbers array<long>"))  # ranges read it twice
    postings.repartitionByRange("gram", "bucket").sortWithinPartitions("gram", "bucket").write.parquet(path + "/postings")


def candidates(spark: SparkSession, path: str, q: str | None) -> DataFrame | None:
    """(bucket, number) of the posts that hold every trigram of the query; None if it has none."""
    grams = query_grams(q)
    if not grams:
        return None
    hits = spark.read.parquet(path + "/postings").where(F.col("gram").isin(grams)).select(
        "bucket", F.explode("numbers").alias(NUMBER))
    return hits.groupBy("bucket", NUMBER).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).drop("n")


def search(spark: SparkSession, path: str, q: str | None = None, tag: str | None = None) -> DataFrame:
    """The posts of an index that match, with their columns."""
    posts = spark.read.parquet(path + "/posts")
    names = [c for c in posts.columns if c not in ("bucket", NUMBER)]
    found = candidates(spark, path, q)
    if found is not None:
        found = written(found)
        buckets = [r[0] for r in found.select("bucket").distinct().collect()]  # at most the number of buckets
        posts = posts.where(F.col("bucket").isin(buckets)).join(found, ["bucket", NUMBER], "left_semi")
    return posts.where(match_tag(tag) & match_text(q)).select(names)
