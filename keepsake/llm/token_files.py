"""Token-id files: Parquet list columns with dictionary and delta encoding, controlled row groups and page indexes.

A token folder holds two Parquet tables.  ``tokens`` has one row per document in
ascending (doc_id, text) order, over files that each cover one range of ids:

==========  ======================  =====================================================
``doc_id``  long, delta             identifier
``part``    int, dictionary         file number, ascending with the ids
``at``      long, delta             ids of the documents before it in the same file
``n_tokens``  long, delta           its ids, the end id included
``ids``     array<int>, dictionary  the ids, the end id last
``meta``    struct                  the other columns of the input (left out if there are none)
==========  ======================  =====================================================

``parts`` has one row per file: ``part``, ``base`` (ids of all files before it),
``n_tokens``, ``n_docs``.  A document's place in the whole stream is ``base + at``;
so the files are written in one pass, without waiting for each other's counts.
Row groups and pages are small and pages carry indexes of their least and largest
values, so a reader that wants a few documents, or a window of the token stream,
or only the metadata, skips the other pages and columns (``read_tokens``,
``read_window``, ``read_spans``).

Encoding uses the tokenizers library.  Its rules for this kind of file (words, single
digits and runs of other signs are tokenized apart, white space is dropped, letters
lower-cased) never reach across white space, nor from a letter or digit to a full stop
or comma.  So texts are cut there, each distinct chunk is encoded once by a worker
(which remembers up to ``REMEMBER``), and numpy puts the ids together.

The text is exchanged once (range partitions by id and a hash of the text, so rows
that repeat an id spread too).  Nothing is collected; ``parts`` has as many rows as
files, and only its running sum is made in one task.

Defined results: a null text is empty and has the end id alone; a null id sorts
first; rows that repeat an id are ordered by their text, equal rows are written
each; an empty table gives empty files and no rows; a very long text is one row;
other columns go to ``meta`` whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.llm.byte_words import LOWER, blocks, byte_class, coded, raw_bytes, texts_of
from keepsake.llm.common import arrow_rows, materialise
from keepsake.session import ship_package

#: Appended to each document.
END_ID = 2
#: Distinct chunks that a worker remembers, of SHORT bytes on average at most, before it starts anew.
REMEMBER = 2_000_000
SHORT = 32
#: Bytes of text that a worker encodes at a time; a longer text is encoded alone.
BLOCK = 4 << 20
#: Documents that Spark hands to a worker at a time.
ROWS = 1000
#: Uncompressed bytes of a row group and of a page.
ROW_GROUP = 16 << 20
PAGE = 256 << 10


def _byte_kinds() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = BLANK
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    table[list(b".,;:!?")] = STOP
    return table


#: What a byte is part of, as far as that settles where a token can't reach across.
BLANK, LETTER, STOP, OTHER = range(4)
KINDS = _byte_kinds()


def byte_kinds(raw: np.ndarray) -> np.ndarray:
    """Kind of each byte; U+00C0 to U+024F count as letters, with three exceptions."""
    kinds = KINDS[raw]
    high = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
    high = high[high + 1 < len(raw)]
    # two signs, and a letter whose small form ends with a mark
    high = high[~(((raw[high] == 0xC3) & np.isin(raw[high + 1], (0x97, 0xB7))) | ((raw[high] == 0xC4) & (raw[high + 1] == 0xB0)))]
    kinds[high] = kinds[high + 1] = LETTER
    return kinds


def chunk_spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks of all texts in a row, each text's number of chunks).

    Texts are cut at white space and between a letter or digit and one of ``.,;:!?``,
    across which no token reaches, and their ASCII letters lower-cased.  A text that
    may name a special token is only cut at white space.
    """
    raw, ends = raw_bytes(texts)
    kinds, low = byte_kinds(raw), LOWER[raw]
    for k in np.flatnonzero(pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False)):
        own = slice(ends[k], ends[k + 1])
        low[own] = raw[own]
        kinds[own][kinds[own] != BLANK] = OTHER
    inside = kinds != BLANK
    begins = inside.copy()
    before, here = kinds[:-1], kinds[1:]
    cut = (before == BLANK) | ((before == LETTER) & (here == STOP)) | ((before == STOP) & (here == LETTER))
    begins[1:] &= cut
    edges = ends[:-1][ends[:-1] < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    kept = low[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(kept)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return chunks, np.diff(np.searchsorted(starts, ends))


#: Bytes of which a chunk is one word to the tokenizer: ASCII letters, and those that spell U+00C0 to U+024F.
_ONE_WORD = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)])


def _parts(places: np.ndarray, most: int = 8192) -> list[np.ndarray]:
    return [places[k:k + most] for k in range(0, len(places), most)]


_SIGNS = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def span_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings, to look them up by; equal hashes are compared further."""
    raw, ends = raw_bytes(words)
    if not _POWERS or len(_POWERS[0]) < len(raw):
        size = max(1 << 20, 2 * len(raw))
        _POWERS[:] = [np.full(size, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        for powers in _POWERS:
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SIGNS[raw] * _POWERS[0][:len(raw)], out=sums[1:])
    h = (sums[ends[1:]] - sums[ends[:-1]]) * _POWERS[1][np.minimum(ends[:-1], max(0, len(raw) - 1))]
    return h ^ (h >> np.uint64(29))


class ChunkEncoder:
    """Ids of texts by the tokenizers library, each distinct chunk encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        suffix = self.library.model.end_of_word_suffix
        spelled = self.library.get_vocab()
        self.word_end = np.zeros(max(spelled.values()) + 1, bool)
        self.word_end[[i for t, i in spelled.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.hashes, self.by_hash = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.used = 0

    def _sizes(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many each has)."""
        joined = b" ".join(chunks).decode()
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        stops = np.flatnonzero(self.word_end[ids]) + 1
        if len(stops) == len(chunks):
            return ids, np.diff(stops, prepend=0)
        words = [c.decode() for c in chunks]  # some are several words to the tokenizer
        found = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))

    def _learn(self, new: pa.Array) -> None:
        """Adds distinct chunks: encodes them, those that are one word each apart from the others."""
        chunks, base = new.to_pylist(), len(self.words)
        if base + len(chunks) > len(self.sizes):
            room = np.zeros(max(len(self.sizes), len(chunks)), np.int32)
            self.starts, self.sizes = np.concatenate([self.starts, room]), np.concatenate([self.sizes, room])
        raw, ends = raw_bytes(new)  # no chunk is empty
        single = np.logical_and.reduceat(_ONE_WORD[raw], ends[:-1])
        for kind in (single, ~single):
            for some in _parts(np.flatnonzero(kind)):
                ids, sizes = self._sizes([chunks[k] for k in some])
                if self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
                self.ids[self.used:self.used + len(ids)] = ids
                self.sizes[base + some] = sizes
                self.starts[base + some] = self.used + np.cumsum(sizes) - sizes
                self.used += len(ids)
        self.words = pa.concat_arrays([self.words, new])

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """The number of each distinct chunk, learnt if need be."""
        if len(self.words) + len(distinct) > REMEMBER or self.words.nbytes > SHORT * REMEMBER:
            self._forget()
        hashes = span_hashes(distinct)
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(0, len(self.hashes) - 1))
        number = np.full(len(distinct), -1, np.int64)
        alike = np.flatnonzero(self.hashes[near] == hashes) if len(self.hashes) else near[:0]
        found = self.by_hash[near[alike]]
        same = pc.equal(self.words.take(pa.array(found)), distinct.take(pa.array(alike))).to_numpy(zero_copy_only=False)
        number[alike[same]] = found[same]
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.words) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)))
            order = new[np.argsort(hashes[new], kind="stable")]
            self.hashes = np.insert(self.hashes, at[order], hashes[order])
            self.by_hash = np.insert(self.by_hash, at[order], number[order])
        return number

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last one ends)."""
        chunks, per_text = chunk_spans(texts_of(texts))
        codes, distinct = coded(chunks)
        chunk = self._places(distinct)[codes]
        starts, sizes, known = self.starts[chunk], self.sizes[chunk], self.ids[:self.used]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        if end_id is not None:  # one more chunk of one id at each text's end
            known = np.append(known, np.int32(end_id))
            starts = np.insert(starts, bounds[1:], self.used)
            sizes = np.insert(sizes, bounds[1:], 1)
            bounds = bounds + np.arange(len(bounds))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        where = np.repeat(starts - ends[:-1], sizes)
        where += np.arange(ends[-1])
        return known[where], ends[bounds]


_LOADED: dict[str, ChunkEncoder] = {}


def load(path: str) -> ChunkEncoder:
    """The encoder of a tokenizer's file, one per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def _encode(path: str, end_id: int, with_meta: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = load(path), 0
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                ids, ends = encoder.encode(b.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                columns = {"doc_id": b.column("doc_id"), "at": pa.array(at + ends[:-1]),
                           "n_tokens": pa.array(np.diff(ends)), "ids": lists}
                if with_meta:
                    columns["meta"] = b.column("meta")
                at += int(ends[-1])
                yield pa.RecordBatch.from_pydict(columns)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Writes the token folder of ``docs`` at ``path`` (which must not exist)."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    meta = [F.struct([F.col(f"`{c}`") for c in rest]).alias("meta")] if rest else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), *meta)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("at", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if rest:
        fields.append(rows.schema["meta"])
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    coded = ordered.mapInArrow(_encode(tokenizer, end_id, bool(rest)), T.StructType(fields))
    out = coded.withColumn("part", F.spark_partition_id())
    writer = (out.select("doc_id", "part", "at", "n_tokens", "ids", *(["meta"] if rest else [])).write
              .option("parquet.writer.version", "PARQUET_2_0")
              .option("parquet.block.size", row_group).option("parquet.page.size", page)
              .option("parquet.dictionary.page.size", 1 << 20))
    for column in ("doc_id", "at", "n_tokens"):  # without a dictionary, version 2 writes deltas
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    with arrow_rows(docs.sparkSession, ROWS):
        writer.parquet(f"{path}/tokens")
    counts = docs.sparkSession.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    counts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_tokens", "n_docs") \
        .coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows: doc_id, start (ids of all documents before it), n_tokens, ids and meta.

    Columns that aren't used aren't read; a filter on ``doc_id`` skips files, row groups and pages.
    """
    rows = spark.read.parquet(f"{path}/tokens")
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    rest = [c for c in rows.columns if c == "meta"]
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids", *rest)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Where each document lies in the stream, without its ids."""
    return read_tokens(spark, path).drop("ids")


def read_window(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """The part of each document that lies among ``count`` ids from the ``first`` one on, in stream order by ``start``.

    Only files that overlap the window are read, and of those only pages with such documents.
    """
    last = first + count
    parts = spark.read.parquet(f"{path}/parts").filter(
        (F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).select("part", "base")
    hit = [r["part"] for r in parts.select("part").sort("part").collect()]  # files of one window
    bounds = [min(hit), max(hit)] if hit else [0, -1]
    rows = spark.read.parquet(f"{path}/tokens").filter(F.col("part").between(*bounds)).join(parts, "part")
    start = F.col("base") + F.col("at")
    inside = rows.filter((start < last) & (start + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - start, F.lit(0))
    upto = F.least(F.lit(last) - start, F.col("n_tokens"))
    return inside.select("doc_id", (start + skip).alias("start"),
                         F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        ends = np.asarray(lists.offsets, np.int64)
        flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        sums = [zlib.crc32(flat[4 * a:4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    ship_package(rows.sparkSession)
    return materialise(rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"), ROWS)
