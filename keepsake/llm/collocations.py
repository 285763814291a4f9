"""Phrase collocations: HAT-trie counting, sorted runs merged per prefix partition.

Counting.  A task reads its texts in blocks.  Words get numbers, and each place of a
piece counts the longest phrase of up to ``LONGEST`` words that begins there.  Counts
live in a shallow trie over word numbers whose leaves are hash containers.  The root
is one container; a first word with more than ``BURST`` entries bursts out of it into
a container of its own, and so does a second word out of that.  When a task holds
more than ``HELD`` entries, whole subtrees, largest first, are written out as sorted
runs and forgotten.

Runs.  Every phrase belongs to the partition of its prefix, its first two words (by a
hash of those).  A spill gives one row per partition: the distinct words that it
needs, and its phrases as sorted columns of numbers into those, with counts.

Merging.  The rows of a partition meet in one task, which merges their runs.  There all
phrases of a prefix are together, so the count of two words is the sum over the third;
single words are runs of their own.  Only counts of at least ``LEAST`` go on: every part
of a phrase that occurs so often occurs as often itself.  A prefix that fills a third of
all texts weighs, in a partition, its distinct third words per run.  Partitions are
``PARTITIONS`` times the session's shuffle partitions, which thus bound a task's memory.

Scoring.  Each candidate looks up the counts of its parts by equi-joins; all arithmetic
is on longs and decimals.

Defined results: a null text is empty; a null language is ``und`` (and so joins one
of that name); words are what lies between blanks and tabs inside a piece; a
language without candidates has no rows; repeated rows count each; an empty table
gives no rows; further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.byte_words import blocks, byte_class, coded, found_words, raw_bytes, texts_of
from keepsake.llm.common import materialise
from keepsake.session import ship_package

#: Words of the longest phrase.
LONGEST = 3
#: Least count of a candidate.
LEAST = 10
#: A candidate goes if a longer one around it has this share of its count, in percent.
COVERED = 50
#: Phrases returned per language.
TOP = 2000
#: Entries at which a hash container bursts, and that a task holds at most.
BURST = 2048
HELD = 400_000
#: Bytes of text that a task reads at a time; a longer text is read alone.
BLOCK = 2 << 20
#: Documents, or rows of runs, that Spark hands to a worker at a time.
ROWS = 1000
#: Prefix partitions for each of the session's shuffle partitions, and least number of them.
PARTITIONS, FEWEST = 2, 64
BREAKS = byte_class([ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E)))
WORD = ~(BREAKS | byte_class([0x20, 0x09]))
#: A phrase as one number: its words' numbers of 21 bits each, 0 for no word.
BITS = 21
#: Places of a text that are counted at a time, each with up to two new words, and words at which numbering starts anew.
SEGMENT = 500_000
NUMBERS = 400_000
_LOW = (1 << BITS) - 1
#: SQL of a phrase's first word, last word, all but the first and all but the last.
FIRST = "substring_index(phrase, ' ', 1)"
LAST = "substring_index(phrase, ' ', -1)"
TAIL = f"substring(phrase, char_length({FIRST}) + 2)"
HEAD = f"substring(phrase, 1, char_length(phrase) - char_length({LAST}) - 1)"


class HatTrie:
    """Counts of phrases, given as one number of up to three word numbers (from 1; 0 stands for no word).

    ``root`` holds the phrases of rare first words.  ``below`` leads from a first word
    that has burst to a container of (second, third), and from that container's own
    burst second words to containers of third words.  What a container held when a
    word burst out of it stays there; runs add both up.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.clear()

    def clear(self) -> None:
        self.root: dict[int, int] = {}
        self.below: dict[int, Container] = {}
        self.entries = np.zeros(1 << 12, np.int64)  # how many came for each first word
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct phrases, sorted, with their counts."""
        first = keys >> (2 * BITS)
        most = int(first[-1]) + 1 if len(first) else 0
        if most > len(self.entries):
            self.entries = np.concatenate([self.entries, np.zeros(max(most, len(self.entries)), np.int64)])
        self.entries += np.bincount(first, minlength=len(self.entries))
        hot = self.entries[first] > self.burst
        self.held += _add(self.root, keys[~hot], counts[~hot])
        keys, counts, first = keys[hot], counts[hot], first[hot]
        cuts = np.flatnonzero(np.diff(first, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(keys)]):
            box = self.below.get(int(first[a]))
            if box is None:
                box = self.below[int(first[a])] = Container()
            self.held += box.add(keys[a:z] & (_LOW << BITS | _LOW), counts[a:z], self.burst)

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Removes the largest subtrees until at most ``keep`` entries stay: their phrases and counts, sorted."""
        keys, counts = [], []
        for word in sorted(self.below, key=lambda w: (-self.below[w].size, w)):
            if self.held <= keep:
                break
            box = self.below.pop(word)
            own, n = box.all()
            keys.append(own | (word << (2 * BITS)))
            counts.append(n)
            self.held -= box.size
        if self.held > keep:
            keys.append(np.fromiter(self.root, np.int64, len(self.root)))
            counts.append(np.fromiter(self.root.values(), np.int64, len(self.root)))
            self.held -= len(self.root)
            self.root = {}
        if not self.held:
            self.clear()
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _added(np.concatenate(keys), np.concatenate(counts))


class Container:
    """The phrases of one first word: of (second, third) or, of second words that have burst, of third words."""

    def __init__(self):
        self.box: dict[int, int] = {}
        self.below: dict[int, dict[int, int]] = {}
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, burst: int) -> int:
        grown = 0
        second = keys >> BITS
        if self.below or len(keys) > burst:
            cuts = np.flatnonzero(np.diff(second, prepend=-1))
            sizes = np.diff(np.append(cuts, len(keys)))
            for a, n in zip(cuts.tolist(), sizes.tolist()):
                word = int(second[a])
                if n > burst // 4 or word in self.below:  # bursts out
                    grown += _add(self.below.setdefault(word, {}), keys[a:a + n] & _LOW, counts[a:a + n])
                else:
                    grown += _add(self.box, keys[a:a + n], counts[a:a + n])
        else:
            grown = _add(self.box, keys, counts)
        self.size += grown
        return grown

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [np.fromiter(self.box, np.int64, len(self.box))], [np.fromiter(self.box.values(), np.int64, len(self.box))]
        for word, box in self.below.items():
            keys.append(np.fromiter(box, np.int64, len(box)) | (word << BITS))
            counts.append(np.fromiter(box.values(), np.int64, len(box)))
        return np.concatenate(keys), np.concatenate(counts)


def _add(box: dict[int, int], keys: np.ndarray, counts: np.ndarray) -> int:
    """Adds counts to a container; returns how many entries are new."""
    before = len(box)
    for k, c in zip(keys.tolist(), counts.tolist()):
        box[k] = box.get(k, 0) + c
    return len(box) - before


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts added up."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new], np.add.reduceat(counts[order], new) if len(new) else counts


def block_phrases(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Second and third word (0: none) after each word of some texts: (first, second, third, distinct words)."""
    raw, ends = raw_bytes(texts)
    starts, counts, found = found_words(raw, ends, WORD)
    codes, words = coded(found)
    codes += 1
    piece = np.cumsum(BREAKS[raw], dtype=np.int64)[starts] if len(starts) else starts
    text = np.repeat(np.arange(len(counts)), counts)
    same = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    second, third = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    second[:-1][same] = codes[1:][same]
    third[:-1][same] = second[1:][same]
    return codes, second, third, words


class LanguageCounter:
    """One language's trie and word numbers within a task."""

    def __init__(self):
        self.trie, self.number, self.spelled, self.hashes = HatTrie(), {}, [b""], [0]

    def add(self, first: np.ndarray, second: np.ndarray, third: np.ndarray, words: list[bytes]) -> None:
        """Counts phrases given by codes from 1 into ``words``; at most SEGMENT of them, so that numbers suffice."""
        codes = np.unique(np.concatenate([first, second, third])) if len(words) > SEGMENT else np.arange(len(words) + 1)
        numbers = np.zeros(len(words) + 1, np.int64)
        for k in codes[codes > 0].tolist():
            w = words[k - 1]
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.spelled)
                self.spelled.append(w)
                self.hashes.append(zlib.crc32(w))
            numbers[k] = n
        self.trie.add(*np.unique((numbers[first] << (2 * BITS)) | (numbers[second] << BITS) | numbers[third],
                                 return_counts=True))

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes the largest subtrees until ``keep`` entries stay: (first, second, third, count), sorted.

        A single word's entry (second is 0) counts its whole subtree.
        """
        keys, n = self.trie.take(keep)
        first, second, third = keys >> (2 * BITS), (keys >> BITS) & _LOW, keys & _LOW
        new = np.flatnonzero(np.diff(first, prepend=-1))
        longer = second > 0
        words = (first[new], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64),
                 np.add.reduceat(n, new) if len(new) else n)
        return tuple(np.concatenate([w, x[longer]]) for w, x in zip(words, (first, second, third, n)))

    def partition(self, lang: int, first: np.ndarray, second: np.ndarray, partitions: int) -> np.ndarray:
        """The prefix partition of each phrase: the same in every task."""
        h = np.array(self.hashes, np.uint64)
        mixed = (h[first] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[second] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(lang)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(32)) % np.uint64(partitions)).astype(np.int64)


def _numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as many bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _from_numbers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}").astype(np.int64)


_RUN = "partition int, lang string, words binary, entries int, first binary, second binary, third binary, n binary"
_COUNT = "lang string, phrase string, n_words int, f long"


def _run_rows(lang: str, counter: LanguageCounter, keep: int, partitions: int) -> list[dict]:
    first, second, third, n = counter.spill(keep)
    if not len(n):
        return []
    place = counter.partition(zlib.crc32(lang.encode()), first, second, partitions)
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    # the words of each partition, and every phrase's words as numbers from 1 among them
    spelled = len(counter.spelled)
    columns = np.stack([x[order] for x in (first, second, third)])
    used, local = np.unique(place * spelled + columns, return_inverse=True)
    local = local.reshape(columns.shape)
    begin = np.searchsorted(used, place[cuts] * spelled)
    none = used[np.minimum(begin, len(used) - 1)] == place[cuts] * spelled  # number 0, no word, is among them
    local -= np.repeat(begin - ~none, np.diff(np.append(cuts, len(n))))
    names = (used % spelled).tolist()
    rows = []
    for k, (a, z) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)])):
        upto = begin[k + 1] if k + 1 < len(begin) else len(names)
        rows.append({"partition": int(place[a]), "lang": lang, "entries": z - a, "n": _numbers(n[a:z]),
                     "words": b" ".join(map(counter.spelled.__getitem__, names[begin[k] + none[k]:upto])),
                     **{c: _numbers(local[j, a:z]) for j, c in enumerate(("first", "second", "third"))}})
    return rows


def _runs(held: int, partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, LanguageCounter] = {}

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            whole = max(1, sum(c.trie.held for c in counters.values()))
            for lang in sorted(counters):
                rows = _run_rows(lang, counters[lang], keep * counters[lang].trie.held // whole, partitions)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)
                if not counters[lang].trie.held:
                    del counters[lang]
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                texts, langs = texts_of(b.column("text")), b.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    first, second, third, words = block_phrases(texts.filter(pc.equal(langs, lang)))
                    spelled = words.to_pylist()
                    for k in range(0, len(first), SEGMENT):
                        part = slice(k, k + SEGMENT)
                        counters.setdefault(lang, LanguageCounter()).add(first[part], second[part], third[part], spelled)
                        if sum(c.trie.held for c in counters.values()) > held:
                            yield from spilled(held // 4)
                        if lang in counters and len(counters[lang].number) > NUMBERS:  # also those of spilled subtrees
                            rows = _run_rows(lang, counters.pop(lang), 0, partitions)
                            if rows:
                                yield pa.RecordBatch.from_pylist(rows, schema=_RUN_SCHEMA)
        yield from spilled(0)
    return run


_RUN_SCHEMA = pa.schema([("partition", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("entries", pa.int32()),
                         ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary()), ("n", pa.binary())])


def phrase_runs(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", held: int = HELD,
                partitions: int | None = None) -> DataFrame:
    """The sorted runs of all tasks, a row per prefix partition and language of each."""
    spark = docs.sparkSession
    ship_package(spark)
    if partitions is None:
        partitions = max(FEWEST, PARTITIONS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_runs(held, partitions), _RUN)


def merge(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """One language's runs of a partition merged: (first, second, third, count) sorted, and the distinct words from number 1."""
    blob = np.frombuffer(b" ".join(r["words"] for r in rows) + b" ", np.uint8)
    codes, words = coded(found_words(blob, np.array([0, len(blob)]), _NO_BLANK)[2])
    base = 0
    parts = []
    for r in rows:
        own = np.concatenate([[0], codes[base:base + r["words"].count(b" ") + 1] + 1])
        base += len(own) - 1
        parts.append([own[_from_numbers(r[k], r["entries"])] for k in ("first", "second", "third")]
                     + [_from_numbers(r["n"], r["entries"])])
    first, second, third, n = (np.concatenate(x) for x in zip(*parts))
    kinds = len(words) + 1
    if kinds ** 3 < 1 << 63:
        key = (first * kinds + second) * kinds + third
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
    else:
        order = np.lexsort((third, second, first))
        changed = [np.diff(x[order], prepend=-1) != 0 for x in (first, second, third)]
        new = np.flatnonzero(changed[0] | changed[1] | changed[2])
    at = order[new]
    return first[at], second[at], third[at], np.add.reduceat(n[order], new), words


_NO_BLANK = ~byte_class([0x20])


def _merged(least: int):
    """Phrases that occur at least ``least`` times, and (with no phrase) the words of a language, of one partition after another."""
    def counts(lang: str, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        first, second, third, n, words = merge(rows)
        spelled = pa.concat_arrays([pa.array([b""], pa.large_binary()), words])
        single, double = second == 0, second > 0
        pair = np.flatnonzero(double & np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        pair_n = np.add.reduceat(np.where(double, n, 0), pair) if len(pair) else n[:0]
        triple = third > 0
        found = [((first[single],), n[single]), ((first[pair], second[pair]), pair_n),
                 ((first[triple], second[triple], third[triple]), n[triple])]
        yield pa.RecordBatch.from_pydict({"lang": [lang], "phrase": [""], "n_words": pa.array([0], pa.int32()),
                                          "f": pa.array([int(n[single].sum())], pa.int64())})
        for size, (keys, f) in enumerate(found, 1):
            often = np.flatnonzero(f >= least)
            if len(often):
                phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(k[often])) for k in keys],
                                                     pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.repeat(pa.scalar(lang, pa.string()), len(often)), "phrase": phrase.cast(pa.large_string()).cast(pa.string()),
                    "n_words": pa.array(np.full(len(often), size), pa.int32()), "f": pa.array(f[often], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if (r["partition"], r["lang"]) != here:
                    if rows:
                        yield from counts(here[1], rows)
                    here, rows = (r["partition"], r["lang"]), []
                rows.append(r)
        if rows:
            yield from counts(here[1], rows)
    return run


def merged_counts(runs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, n_words, f of the phrases that occur ``least`` times; per language also a row of its words in all (0 words)."""
    dealt = runs.repartition("partition").sortWithinPartitions("partition", "lang")
    return dealt.mapInArrow(_merged(least), _COUNT)


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) with the cut that scores least; ``counts`` holds their parts."""
    f = counts.select("lang", "phrase", "f")
    long = F.col("n_words") == 3
    wide = candidates.withColumnRenamed("f", "a").withColumns(
        {"k1": F.expr(FIRST), "k1_rest": F.expr(TAIL), "k2": F.when(long, F.expr(HEAD)), "k2_rest": F.when(long, F.expr(LAST))})

    def looked_up(df: DataFrame, key: str, how: str = "inner") -> DataFrame:
        part = f.select(F.col("lang"), F.col("phrase").alias(key), F.col("f").alias(f"f_{key}"))
        return df.join(part, ["lang", key], how)
    two = looked_up(looked_up(wide, "k1"), "k1_rest")
    three = looked_up(looked_up(two, "k2", "left"), "k2_rest", "left")

    def score(left: str, right: str) -> str:
        a = "cast(a as decimal(15, 0))"
        return (f"cast(1000000 as decimal(7, 0)) * ({a} * {a}) div "
                f"(cast({left} as decimal(15, 0)) * cast({right} as decimal(15, 0)))")
    cuts = three.withColumns({"s1": F.expr(score("f_k1", "f_k1_rest")), "s2": F.expr(score("f_k2", "f_k2_rest"))})
    later = F.col("s2") < F.col("s1")
    return cuts.select("lang", "phrase", "a", F.when(later, F.col("f_k2")).otherwise(F.col("f_k1")).alias("l"),
                       F.when(later, F.col("f_k2_rest")).otherwise(F.col("f_k1_rest")).alias("r"),
                       F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score"))


def uncovered(counts: DataFrame, share: int = COVERED) -> DataFrame:
    """``counts`` without the two-word phrases inside a three-word one that has ``share`` percent of their count."""
    around = counts.filter("n_words = 3").select("lang", F.explode(F.array(F.expr(HEAD), F.expr(TAIL))).alias("phrase"),
                                                 F.col("f").alias("most"))
    most = around.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    pairs = counts.filter("n_words = 2").join(most, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < share * F.col("f")))
    return pairs.drop("most").unionByName(counts.filter("n_words = 3"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    counts = materialise(merged_counts(phrase_runs(docs, text_col, lang_col), least), ROWS)
    total = counts.filter("n_words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.filter("n_words > 0")
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (scored(uncovered(often), often).withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
