"""Source divergence audit: kept terms by iceberg prefix refinement, then exact divergences between sources.

A term is kept for a language if at least ``LEAST`` of its documents hold it.  Most
distinct terms are rarer than that, and they are what a plain count would have to
move.  Refinement finds the kept ones level by level: at each level a document adds
one to every distinct byte prefix of that level's length among its terms, and one to
every complete term that is no longer than that.  Prefixes with fewer than ``LEAST``
documents go; no term below them can be kept.  The next level extends only what is
left, until no incomplete prefix remains.

What is left of a level is told to the next one as a bit map of prefix hashes.  Its
size follows the number of prefixes up to ``MAP_BITS`` (32 MB), so it may be
broadcast; a clash of hashes only lets a rare prefix through to the next count, where
it goes.  Counts themselves are kept by prefix, not by hash, and are exact.

A last pass counts the kept terms per language and source.  Terms absent from a
group have one common share there, so sums over all kept terms need only the terms
that occur: for a pair of sources the terms in either are summed by counts (how many
terms occur so often), and a correction is added for each term in both.

Texts are cut into terms once: a block of texts becomes a row of its sorted distinct
terms and of each text's terms as numbers into those.  Levels read these rows, with
numpy; a document never leaves its row.  Nothing is collected but bit maps and the names of the groups.

Defined results: null text, language and source are empty strings; each row is a
document; a group without terms has all its pairs (value 0 where the language keeps
no term) and no terms; repeated rows count each; a term of any length is refined in
longer steps; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.byte_words import blocks, byte_class, coded, found_words, raw_bytes, texts_of
from keepsake.llm.common import materialise
from keepsake.session import ship_package

#: Documents of its language that hold a kept term, at least.
LEAST = 3
#: Shares are whole numbers of this many parts.
SCALE = 1_000_000_000
#: Terms returned per group.
TOP = 200
#: Bytes of the first levels' prefixes; each later one is four times as long.
LEVELS = (4, 8, 16)
#: Most bits of the map of kept prefixes; at least 16 bits are used for each while that allows.
MAP_BITS = 1 << 28
#: Bytes of text in a block, blocks that a worker is given at a time, and pairs of sources that it sums at a time.
BLOCK = 4 << 20
BAGS = 2
PAIRS = 1 << 18
TERM = ~byte_class([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NAMES = ["lang", "source"]


def level_length(k: int) -> int:
    """Bytes of a prefix at level ``k``."""
    return LEVELS[k] if k < len(LEVELS) else LEVELS[-1] * 4 ** (k - len(LEVELS) + 1)


def found_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each distinct term of each text, in order of text and term: (text, code, count); and the terms by code, sorted."""
    _, counts, found = found_words(*raw_bytes(texts), TERM)
    codes, terms = coded(found)
    order = pc.sort_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    kinds = max(1, len(terms))
    key, n = np.unique(np.repeat(np.arange(len(counts)), counts) * kinds + rank[codes], return_counts=True)
    return key // kinds, key % kinds, n, terms.take(pa.array(order))


class PrefixMap:
    """The bit map of one level's kept prefixes."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)

    def holds(self, lang: int, prefixes: list[bytes]) -> np.ndarray:
        begin = zlib.crc32(b"%d " % lang)
        at = np.fromiter((zlib.crc32(p, begin) for p in prefixes), np.int64, len(prefixes)) & (8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def prefix_map(kept: DataFrame) -> bytes:
    """The bit map of (lang, item), as large as their number asks, up to MAP_BITS."""
    n = kept.count()
    bits = 1 << 15
    while bits < 16 * n and bits < MAP_BITS:
        bits *= 2
    place = F.crc32(F.concat(F.concat(F.col("lang").cast("string"), F.lit(" ")).cast("binary"), F.col("item"))) % bits + 1
    parts = (kept.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = bytearray(bits // 8)
    for row in parts:  # 4096 bytes each, at most MAP_BITS in all
        out[4096 * (row["bucket"] - 1):4096 * row["bucket"]] = row["bits"]
    return bytes(out)


class Groups:
    """Every (language, source), numbered, and the languages' numbers: a row each on the driver and in each worker.

    The result has a row for each pair of a language's sources, so this is the smaller part of it.
    """

    def __init__(self, bags: DataFrame):
        found = bags.select("lang", F.explode("sources").alias("source")).distinct().collect()
        self.names = sorted((r["lang"], r["source"]) for r in found)
        self.langs = {lang: k for k, lang in enumerate(sorted({lang for lang, _ in self.names}))}
        self.numbers = {name: k for k, name in enumerate(self.names)}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.langs[lang], lang, k, source) for k, (lang, source) in enumerate(self.names)]
        return spark.createDataFrame(rows, "lang int, lang_name string, group int, source string")


_BAGS = ("lang string, sources array<string>, source binary, doc binary, code binary, n binary, terms array<binary>")


def _bag(block: int):
    """One row per language of a block of texts: the sorted distinct terms, and each text's terms by code with counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", block):
                langs = b.column("lang")
                kinds = pc.unique(langs).to_pylist()
                for lang in kinds:
                    own = b if len(kinds) == 1 else b.filter(pc.equal(langs, lang))
                    doc, code, n, terms = found_terms(texts_of(own.column("text")))
                    sources = own.column("source").dictionary_encode()
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang], pa.string()),
                        "sources": pa.array([sources.dictionary.to_pylist()], pa.list_(pa.string())),
                        "source": _packed(sources.indices.to_numpy(zero_copy_only=False)), "doc": _packed(doc),
                        "code": _packed(code), "n": _packed(n),
                        "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms.cast(pa.binary()))})
    return run


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([values.astype("<u4").tobytes()], pa.binary())


class Bag:
    """One row of the bags table; numbers stay as small as they came."""

    def __init__(self, b: pa.RecordBatch, k: int, groups: Groups):
        name = b.column("lang")[k].as_py()
        self.lang = groups.langs[name]
        self.groups = np.array([groups.numbers[name, s] for s in b.column("sources")[k].as_py()], np.int64)
        self.source, self.doc, self.code, self.n = (
            np.frombuffer(b.column(c)[k].as_buffer(), "<u4") for c in ("source", "doc", "code", "n"))
        self.terms = b.column("terms")[k].values


def _summed(parts: list[tuple[int, pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Parts (lang, items, second key, count) with equal keys added up, a batch per language."""
    for lang in sorted({p[0] for p in parts}):
        own = [p for p in parts if p[0] == lang]
        code, items = coded(pa.concat_arrays([p[1] for p in own]))
        second, n = (np.concatenate([p[k] for p in own]) for k in (2, 3))
        width = int(second.max(initial=0)) + 1
        key = code * width + second
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        if len(at):
            key = key[order][at]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(np.full(len(at), lang), pa.int32()), "item": items.take(pa.array(key // width)).cast(pa.binary()),
                "second": pa.array(key % width, pa.int32()), "n": pa.array(np.add.reduceat(n[order], at), pa.int64())})


_PART = "lang int, item binary, second int, n long"
#: Entries that a worker adds up before it passes them on.
ENTRIES = 1_500_000


def _counting(groups, count):
    """Applies ``count`` (bag -> part or None) to the rows of the bags table and adds parts up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for k in range(b.num_rows):
                part = count(Bag(b, k, groups.value))
                if part is not None:
                    parts.append(part)
                    held += len(part[3])
                if held > ENTRIES:
                    yield from _summed(parts)
                    parts, held = [], 0
        yield from _summed(parts)
    return run


def _documents(length: int, before: int, kept_before):
    """Counts documents per prefix of ``length`` bytes (second key 0) and per complete term (1), of terms whose earlier
    prefix is kept."""
    def count(bag: Bag):
        sizes = pc.binary_length(bag.terms).to_numpy(zero_copy_only=False)
        alive = np.flatnonzero(sizes > before)
        if kept_before is not None and len(alive):
            heads = pc.binary_slice(bag.terms.take(pa.array(alive)), 0, before).to_pylist()
            alive = alive[PrefixMap(kept_before.value).holds(bag.lang, heads)]
        if not len(alive):
            return None
        cut = pc.binary_slice(bag.terms.take(pa.array(alive)), 0, length)
        same, whole = coded(cut)[0], sizes[alive] <= length
        # terms are sorted, so those of one prefix stand together, and so do they in each text
        new = np.concatenate([[True], (same[1:] != same[:-1]) | (whole[1:] != whole[:-1])])
        item_of = np.full(len(sizes), -1, np.int32)
        item_of[alive] = np.cumsum(new) - 1
        own = item_of[bag.code]
        there = own >= 0
        own, doc = own[there], bag.doc[there]
        first = np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])[:len(own)]
        at = np.flatnonzero(new)
        return bag.lang, cut.take(pa.array(at)), whole[at].astype(np.int64), np.bincount(own[first], minlength=len(at))
    return count


def _occurrences(kept_terms):
    """Counts the occurrences of terms in the map, per group (second key)."""
    def count(bag: Bag):
        if not len(bag.terms):
            return None
        wanted = PrefixMap(kept_terms.value).holds(bag.lang, bag.terms.to_pylist())
        there = wanted[bag.code]
        kinds = len(bag.terms)
        key, n = bag.source[bag.doc[there]].astype(np.int64) * kinds + bag.code[there], bag.n[there]
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(at):
            return None
        return bag.lang, bag.terms.take(pa.array(key[at] % kinds)), bag.groups[key[at] // kinds], np.add.reduceat(n, at)
    return count


def term_bags(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
              block: int = BLOCK) -> DataFrame:
    """The texts' distinct terms and counts, a row per language of a block of texts, written once."""
    ship_package(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return materialise(rows.mapInArrow(_bag(block), _BAGS), 1000, **{"parquet.block.size": 2 * block})


def kept_terms(bags: DataFrame, groups, least: int = LEAST) -> DataFrame:
    """(lang, item) of the terms that at least ``least`` documents of a language hold; item is the term's bytes.

    ``groups``: the broadcast :class:`Groups` of the bags.
    """
    sc = bags.sparkSession.sparkContext
    kept, before, told, k = None, 0, None, 0
    while True:
        length = level_length(k)
        counts = bags.mapInArrow(_counting(groups, _documents(length, before, told)), _PART)
        level = materialise(counts.groupBy("lang", "item", "second").agg(F.sum("n").alias("docs"))
                            .filter(F.col("docs") >= least), BAGS)
        done = level.filter("second = 1").select("lang", "item")
        kept = done if kept is None else kept.unionByName(done)
        left = level.filter("second = 0").select("lang", "item")
        if left.isEmpty():
            return kept
        told, before, k = sc.broadcast(prefix_map(left)), length, k + 1


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)); in decimals where the product passes 63 bits."""
    big = F.lit(SCALE).cast("decimal(10, 0)") * (count + 1).cast("decimal(20, 0)")
    exact = F.call_function("div", big, (total + kinds).cast("decimal(20, 0)"))
    return F.when(count < 9 * SCALE, F.call_function("div", F.lit(SCALE) * (count + 1), total + kinds)).otherwise(exact) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                     least: int = LEAST, top: int = TOP, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from each other source, and the terms a source has more of."""
    spark = docs.sparkSession
    bags = term_bags(docs, text_col, lang_col, source_col, block)
    known = Groups(bags)
    told = spark.sparkContext.broadcast(known)
    kept = materialise(kept_terms(bags, told, least))
    wanted = spark.sparkContext.broadcast(prefix_map(kept))
    counted = (bags.mapInArrow(_counting(told, _occurrences(wanted)), _PART)
               .groupBy("lang", "item", "second").agg(F.sum("n").alias("n")))
    found = materialise(counted.join(kept, ["lang", "item"], "left_semi").withColumnRenamed("second", "group"), BAGS)
    groups = materialise(_shares(known.frame(spark), found, kept))
    sides = found.join(groups.select("group", "total", "kinds", "lang_total", "p0"), "group").withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("kinds")))
    sums = materialise(_term_sums(sides, top, pairs), 20_000)
    ranked = _ranked(_pair_values(found, sums, groups), None)
    terms = sums.filter("item is not null").join(_named(groups), "group").select(
        *NAMES, F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    return ranked.unionByName(_ranked(terms, top))


def _named(groups: DataFrame) -> DataFrame:
    return groups.select("group", F.col("lang_name").alias("lang"), "source")


def _shares(groups: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """The groups with their occurrences, kinds of terms, and the share of an absent term."""
    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    sums = found.groupBy("group").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_kinds"))
    filled = groups.join(sums, "group", "left").join(kinds, "lang", "left").select(
        *groups.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "own_kinds", "kinds")])
    return (filled.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))  # one row per source
            .withColumn("p0", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(1)))


def _ranked(values: DataFrame, top: int | None) -> DataFrame:
    by = Window.partitionBy(*NAMES).orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(by))
    return (out if top is None else out.filter(F.col("rank") <= top)).select(*NAMES, "part", "item", "value", "rank")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both_sides(code: np.ndarray, p: np.ndarray, p0: np.ndarray) -> pa.RecordBatch:
    """For terms of as many sources each: summed by pair of sources, what the gap is beyond that of absent terms."""
    a, b = (x.ravel() for x in np.broadcast_arrays(code[:, :, None], code[:, None, :]))
    pa_, pb = (x.ravel() for x in np.broadcast_arrays(p[:, :, None], p[:, None, :]))
    a0, b0 = (x.ravel() for x in np.broadcast_arrays(p0[:, :, None], p0[:, None, :]))
    value = gaps(pa_, pb) - gaps(pa_, b0) - gaps(a0, pb) + gaps(a0, b0)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    apart = a[at] != b[at]
    sums = np.add.reduceat(value[order], at)[apart]
    return pa.RecordBatch.from_pydict({
        "group": pa.array(a[at][apart], pa.int32()), "other": pa.array(b[at][apart], pa.int32()), "item": pa.nulls(len(sums), pa.binary()), "value": pa.array(sums)})


def _term_rows(top: int, pairs: int):
    """Sums over pairs of sources, and each source's best terms, of rows (lang, item, q, entries)."""
    def best(items, q, ends, code, p):
        row = np.repeat(np.arange(len(q)), np.diff(ends))
        more = p > q[row]
        row, code, value = row[more], code[more], gaps(p[more], q[row[more]])
        rank = pc.sort_indices(items).to_numpy(zero_copy_only=False)  # byte order
        place = np.empty(len(items), np.int64)
        place[rank] = np.arange(len(items))
        order = np.lexsort((place[row], -value, code))
        code = code[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[:len(code)])
        first = np.repeat(begin, np.diff(np.append(begin, len(code))))
        take = order[np.arange(len(code)) - first < top]  # more than these can't be among a group's first
        return pa.RecordBatch.from_pydict({
            "group": pa.array(code[np.arange(len(code)) - first < top], pa.int32()),
            "other": pa.nulls(len(take), pa.int32()), "item": items.take(pa.array(row[take])), "value": pa.array(value[take])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("entries")
            ends = np.asarray(lists.offsets, np.int64)
            code, p, p0 = (lists.values.field(k).to_numpy(zero_copy_only=False)[ends[0]:] for k in range(3))
            ends = ends - ends[0]
            yield best(b.column("item"), b.column("q").to_numpy(zero_copy_only=False), ends, code, p)
            sizes = np.diff(ends)
            for size in np.unique(sizes[sizes > 1]).tolist():
                rows = ends[:-1][sizes == size]
                step = max(1, pairs // (size * size))
                for k in range(0, len(rows), step):
                    at = rows[k:k + step, None] + np.arange(size)
                    yield _both_sides(code[at], p[at], p0[at])
    return run


def _term_sums(sides: DataFrame, top: int, pairs: int = PAIRS) -> DataFrame:
    """(group, other, item, value): pair sums over terms in both groups (item null), and terms (other null)."""
    lists = sides.groupBy("lang", "item").agg(  # as many entries as sources
        F.sum("n").alias("lang_n"), F.first("lang_total").alias("lang_total"), F.first("kinds").alias("kinds"),
        F.collect_list(F.struct("group", "p", "p0")).alias("entries"))
    rows = lists.select("item", share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")).alias("q"), "entries")
    return rows.mapInArrow(_term_rows(top, pairs), "group int, other int, item binary, value long")


def _pair_values(found: DataFrame, sums: DataFrame, groups: DataFrame) -> DataFrame:
    """For each ordered pair of a language's sources the sum of gaps over all kept terms.

    Sum over the terms of either source against the other's share of absent terms, plus
    for terms in both what that gets wrong, plus the terms in neither.
    """
    other = groups.select("lang", F.col("group").alias("other"), F.col("p0").alias("p0_b"), F.col("own_kinds").alias("own_b"))
    every = groups.join(other, "lang").filter("group <> other")
    often = found.groupBy("group", "n").agg(F.count(F.lit(1)).alias("n_terms")).join(  # how many terms have a share
        groups.select("lang", "group", "total", "kinds"), "group").withColumn("p", share(F.col("n"), F.col("total"), F.col("kinds")))
    base = groups.select("lang", F.col("group").alias("other"), F.col("p0").alias("base"))
    against = often.select("lang", "group", "p", "n_terms").join(base, "lang").filter("group <> other")
    left = against.select("group", "other", (F.col("n_terms") * gap(F.col("p"), F.col("base"))).alias("value"))
    right = against.select(F.col("other").alias("group"), F.col("group").alias("other"),
                           (F.col("n_terms") * gap(F.col("base"), F.col("p"))).alias("value"))
    neither = F.col("kinds") - F.col("own_kinds") - F.col("own_b")
    rest = every.select("group", "other", (neither * gap(F.col("p0"), F.col("p0_b"))).alias("value"))
    both = sums.filter("item is null").select("group", "other", "value")
    total = (rest.unionByName(left).unionByName(right).unionByName(both)
             .groupBy("group", "other").agg(F.sum("value").alias("value")))
    items = groups.select(F.col("group").alias("other"), F.col("source").alias("item"))
    return total.join(_named(groups), "group").join(items, "other").select(
        *NAMES, F.lit("pair").alias("part"), "item", "value")
