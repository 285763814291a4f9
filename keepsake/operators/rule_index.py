"""Categorisation for large rule tables: an index of texts instead of one expression per rule.

The projection of ``operators/rules.py`` evaluates every rule on every row, which suits
hundreds of rules.  Here a rule table of any size stays a table:

1. Every match of a keyword pattern holds one of its required literals
   (``rules.required_literals``); these are its keys.  A pattern that is one whole word
   has that word as its only key.
2. A bit map tells every task which hashes the keys have: of whole words, of literals, and of
   literals' first ``LONG`` bytes.  Rolling hashes find the places of a haystack where a literal may begin, and there
   which literals it may be.  The map only ever lets more through.
3. What it lets through are postings: a key, with the numbers of a block's posts that
   hold it.  A key travels once a block, not once a post; one join with the rules' keys
   says which are really there.
4. A rule that is one whole word or one plain text is decided by its key.  The other
   (post, rule) candidates meet the post's haystack again by its row number, where the
   regular expression decides.

Patterns without a required literal (``\\d+`` alone) have no gram; these few are
evaluated on every row as literal expressions.  Domain rules are one equi-join as
well: each host gives all its suffixes after a dot, and those meet the domains.

Haystacks are searched as bytes of UTF-8, in which a text only begins where a character
does.  Two small letters fold onto ASCII letters when case is ignored
(``rules.FOLD_SPECIALS``); keys are looked for after folding them.

What is exchanged by key are postings, and by block the found ones, put together by
category before; a key in a third of all posts costs two bytes a post.

Defined results: as ``rules.category_points``; rules given twice count twice; an empty
rule table gives no rows; posts that repeat an id are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.operators import rules as R
from keepsake.session import ship_package, written

#: Characters of a gram; of a literal of at least ``LONG`` characters, that many.
Q, LONG = 3, 6
#: Rules from which on ``points`` uses the index.
MANY_RULES = 1000
#: Prefix of a key that is a whole word; of one that is any text; a gram's is its length.
WORD, TEXT = "w", "t"
#: Posts of a block at most, and bytes of their texts from which on it ends.
BLOCK_POSTS, BLOCK_BYTES = 1 << 15, 16 << 20
#: Bits of the map per key, and in all at most (32 MB).
KEY_BITS, MAP_BITS = 32, 1 << 28
#: Bytes of a haystack that are hashed at once.
WINDOW = 1 << 20


def gram_size(literal: str) -> int:
    return LONG if len(literal) >= LONG else min(Q, len(literal))


def _grams(literal: str) -> list[str]:
    n = gram_size(literal)
    return [f"{n}:{literal[k:k + n]}" for k in range(len(literal) - n + 1)]


def compile_pattern(pattern: str) -> dict:
    """What the index needs of a keyword pattern.

    ``any_of``: literals of which one must occur; ``literals``: for each of them the keys
    that all occur with it; None without literals.  ``bare``: the text that the pattern
    is, if it has no edges.  ``sure``: whether a haystack that holds the key is a match:
    the pattern is one whole word, or a bare text that is its own gram.
    """
    any_of = R.required_literals(pattern)
    left, literal, right = R.plain_parts(pattern) or ("", "", "")
    word = bool(left and right) and all(map(R.is_word_char, literal))
    bare = literal if literal and not (left or right) else None
    sure = word or (bare is not None and gram_size(bare) == len(bare))
    keys = [[f"{WORD}:{literal}"]] if word else any_of and [_grams(x) for x in any_of]
    return {"regex": R.spark_regex(pattern), "sure": sure, "bare": bare, "any_of": any_of, "literals": keys}


@lru_cache(maxsize=1 << 16)
def _plain(ch: str) -> bool:
    """Whether a pattern's character stands for itself in a lower-cased text."""
    return R.is_word_char(ch) and len(ch.lower()) == 1 and R.steady(ch.lower())


def rule_keys(pattern: str) -> tuple[bool, str | None, list[str] | None]:
    """(whether a key decides, the regular expression if not, the keys of which one must occur or None) of a keyword pattern."""
    left, core, right = R.search_edges(pattern)
    if core and all(map(_plain, core)) and (not (left or right) or left == right == r"\b"):  # most of a large table
        return True, None, [f"{WORD if left else TEXT}:{core.lower()}"]
    made = compile_pattern(pattern)
    if made["bare"]:
        return True, None, [f"{TEXT}:{made['bare']}"]
    if made["sure"]:
        return True, None, made["literals"][0]
    return False, made["regex"], made["any_of"] and [f"{TEXT}:{x}" for x in dict.fromkeys(made["any_of"])]


def _compile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [rule_keys(p) if k == "kw" else (False, None, None)
                for k, p in zip(b.column("kind").to_pylist(), b.column("pattern").to_pylist())]
        decided, regex, keys = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(decided, pa.bool_()), pa.array(regex, pa.string()), pa.array(keys, pa.list_(pa.string()))],
            [*b.schema.names, "decided", "regex", "keys"])


def compiled(rules: DataFrame) -> DataFrame:
    """The rule table with a number per rule, its keys, whether they decide and else its regular expression, written once."""
    ship_package(rules.sparkSession)
    spread = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what Python compiles is small but slow
    named = rules.select("category", F.col("ord").cast("int").alias("ord"), "kind", "pattern").repartition(spread)
    made = named.mapInArrow(_compile, "category string, ord int, kind string, pattern string, decided boolean, "
                                      "regex string, keys array<string>")
    return written(made.withColumn("rule", F.monotonically_increasing_id()))


def _folded(hay: Column) -> Column:
    return F.translate(hay, "".join(R.FOLD_SPECIALS), "si")


# -- hashes of stretches of bytes ----------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        steps = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64).repeat(n).reshape(2, n)
        steps[:, 0] = 1
        _POWERS[:] = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _POWERS


class _Rolling:
    """Hashes of any stretches of some bytes, that depend on the stretch's bytes alone."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * power[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]

    def every(self, size: int) -> np.ndarray:
        """Of each stretch of that size."""
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def _places(hashes: np.ndarray, role: int, shift: int) -> np.ndarray:
    """Bits of a map of 2**(64 - shift) bits."""
    mixed = (hashes ^ (hashes >> np.uint64(29)) ^ np.uint64(role * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(shift)


#: What a hash is of: a whole word, a whole literal, the first ``LONG`` bytes of a longer literal.
_OF_WORD, _OF_TEXT, _OF_BEGIN = 1, 2, 3


class KeyMap:
    """What every task is told of the rules' keys: the bit map, whether there are words, the sizes of literals in bytes."""

    def __init__(self, bits: bytes, words: bool, sizes: list[int]):
        self.bits, self.words, self.sizes = np.frombuffer(bits, np.uint8), words, sizes
        self.shift = 64 - (len(bits) * 8).bit_length() + 1

    def holds(self, hashes: np.ndarray, role: int) -> np.ndarray:
        at = _places(hashes, role, self.shift)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def known_words(self, words: pa.Array) -> np.ndarray:
        """Which of some words may be keys."""
        data, ends = _text_bytes(words)
        out, at = np.zeros(len(words), bool), 0
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + WINDOW, "right")) - 1)
            here = _Rolling(data[ends[at]:ends[upto]])
            out[at:upto] = self.holds(here.of(ends[at:upto] - ends[at], ends[at + 1:upto + 1] - ends[at]), _OF_WORD)
            at = upto
        return out

    def known_texts(self, hays: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(number of the haystack, text) of the stretches of some haystacks that may be literals."""
        data, ends = _text_bytes(hays)
        begins, sizes, most = [], [], max(self.sizes)
        for start in range(0, len(data), WINDOW):
            here, last = _Rolling(data[start:start + WINDOW + most - 1]), min(WINDOW, len(data) - start)
            for size in (x for x in self.sizes if x <= LONG):
                found = np.flatnonzero(self.holds(here.every(size)[:last], _OF_TEXT))
                begins.append(found + start)
                sizes.append(np.full(len(found), size))
            if most <= LONG:
                continue
            open_ = np.flatnonzero(self.holds(here.every(LONG)[:last], _OF_BEGIN))
            for size in (x for x in self.sizes if x > LONG):
                open_ = open_[open_ + size < len(here.sums)]  # sizes ascend
                found = open_[self.holds(here.of(open_, open_ + size), _OF_TEXT)]
                begins.append(found + start)
                sizes.append(np.full(len(found), size))
        if not begins:
            return np.zeros(0, np.int64), pa.array([], pa.string())
        begin, size = np.concatenate(begins), np.concatenate(sizes)
        hay = np.searchsorted(ends, begin, "right") - 1
        own = begin + size <= ends[hay + 1]  # no further than its haystack
        begin, size, hay = begin[own], size[own], hay[own]
        return hay, _cut(data, begin, size)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of some texts one after the other, where each begins and the last ends)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of some bytes; what isn't a text is left as null."""
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
    cut = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at])])
    texts = cut.dictionary_encode()
    known = [_text(x) for x in texts.dictionary.to_pylist()]
    return pa.array(known, pa.string()).take(texts.indices)


def _text(x: bytes) -> str | None:
    try:
        return x.decode()
    except UnicodeDecodeError:  # let through by the bit map
        return None


# -- postings ------------------------------------------------------------------------------


def key_map(keys: DataFrame) -> KeyMap:
    """The map of some keys (key), as large as their number asks, up to MAP_BITS."""
    text, kind = F.substring("key", len(WORD) + 2, 1 << 30), F.substring("key", 1, len(WORD))
    facts = keys.groupBy(kind.alias("kind"), F.when(kind == TEXT, F.octet_length(text)).alias("size")).count().collect()
    size = max(16, (KEY_BITS * sum(r["count"] for r in facts)).bit_length())
    size = min(size, MAP_BITS.bit_length() - 1)
    shift = 64 - size

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = pc.utf8_slice_codeunits(b.column("key"), 0, len(WORD))
            data, ends = _text_bytes(pc.utf8_slice_codeunits(b.column("key"), len(WORD) + 1))
            here, begin, end = _Rolling(data), ends[:-1], ends[1:]
            word = pc.equal(marks, WORD).to_numpy(zero_copy_only=False)
            long = ~word & (end - begin > LONG)
            whole = here.of(begin, end)
            found = [_places(whole[word], _OF_WORD, shift), _places(whole[~word], _OF_TEXT, shift),
                     _places(here.of(begin[long], begin[long] + LONG), _OF_BEGIN, shift)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64) + 1)], ["at"])  # Spark's bit maps begin with 1
    parts = (keys.mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = bytearray(1 << (size - 3))
    for r in parts:
        at = (r["bucket"] - 1) * len(r["bits"])
        bits[at:at + len(r["bits"])] = r["bits"]
    return KeyMap(bytes(bits), any(r["kind"] == WORD for r in facts), sorted(r["size"] for r in facts if r["kind"] == TEXT))


class _Block:
    """The postings of posts whose row numbers lie close together."""

    def __init__(self, first: int):
        self.first, self.bytes = first, 0
        self.keys: list[pa.Array] = []
        self.posts: list[np.ndarray] = []

    def add(self, mark: str, texts: pa.Array, posts: np.ndarray) -> None:
        known = texts.dictionary_encode()
        self.keys.append(pa.DictionaryArray.from_arrays(known.indices, pc.binary_join_element_wise(f"{mark}:", known.dictionary, "")).cast(
            pa.string()))
        self.posts.append(posts)

    def batch(self) -> pa.RecordBatch:
        keys = pa.concat_arrays([pa.array([], pa.string()), *self.keys]).dictionary_encode()
        posts = np.concatenate([np.zeros(0, np.int64), *self.posts])
        sure = keys.indices.is_valid().to_numpy(zero_copy_only=False)
        code = keys.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(code[sure] * BLOCK_POSTS + posts[sure])
        code, begin = np.unique(pairs // BLOCK_POSTS, return_index=True)
        at = pa.ListArray.from_arrays(pa.array(np.append(begin, len(pairs)), pa.int32()),
                                      pa.array((pairs % BLOCK_POSTS).astype(np.int16)))
        return pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array(code)), pa.array(np.full(len(code), self.first, np.int64)), at], ["key", "block", "at"])


def _posting(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, block = told.value, None
        for b in batches:
            at = 0
            while at < b.num_rows:
                rows = b.column("row").slice(at, 512).to_numpy()
                block = block or _Block(int(rows[0]))
                near = (rows >= block.first) & (rows < block.first + BLOCK_POSTS)
                n = len(rows) if near.all() else int(np.argmin(near))
                if n:
                    _post(keys, block, b.slice(at, n), rows[:n] - block.first)
                at += n
                if not near.all() or block.bytes >= BLOCK_BYTES:
                    yield block.batch()
                    block = None
        if block is not None:
            yield block.batch()
    return run


def _post(keys: KeyMap, block: _Block, b: pa.RecordBatch, posts: np.ndarray) -> None:
    """Adds some haystacks to a block."""
    if keys.words:
        lists = b.column("words")
        words = lists.flatten()
        known = keys.known_words(words)
        owner = np.repeat(posts, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        block.add(WORD, words.filter(pa.array(known)), owner[known])
    if keys.sizes:
        hay, texts = keys.known_texts(b.column("plain"))
        block.add(TEXT, texts, posts[hay])
    block.bytes += b.nbytes


def postings(hays: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, block, at): which of the haystacks (row, hay) hold a key (key); at has row numbers less the block's.

    A key that isn't in ``keys`` may come along.
    """
    told = key_map(keys)
    plain = _folded(F.col("hay"))
    cols = [F.array_distinct(F.split(plain, R.PY_WORD.replace("[", "[^") + "+")).alias("words")] if told.words else []
    cols += [plain.alias("plain")] if told.sizes else []
    if not cols:
        return hays.select(F.lit("").alias("key"), F.col("row").alias("block"), F.array().cast("array<short>").alias("at")).limit(0)
    return hays.select("row", *cols).mapInArrow(_posting(hays.sparkSession.sparkContext.broadcast(told)),
                                                "key string, block long, at array<short>")


def _keys(rules: DataFrame, *cols: str) -> DataFrame:
    return rules.select(F.explode("keys").alias("key"), *cols)


def decided_hits(hays: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, category, ord, kw): how many of a category's rules that a key decides are in the haystack."""
    found = postings(hays, _keys(rules)).join(_keys(rules, "category", "ord"), "key")
    blocks = found.groupBy("block", "category", "ord").agg(F.collect_list("at").alias("at"))
    return (blocks.select("block", "category", "ord", F.explode(F.flatten("at")).alias("at"))
            .groupBy("block", "at", "category", "ord").agg(F.count(F.lit(1)).alias("kw"))
            .select((F.col("block") + F.col("at")).alias("row"), "category", "ord", "kw"))


def undecided_hits(hays: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, category, ord, kw): a row for every other rule with a literal in the haystack, if its expression is found there."""
    found = postings(hays, _keys(rules)).join(_keys(rules, "rule"), "key")
    pairs = found.select("block", F.explode("at").alias("at"), "rule").select(
        (F.col("block") + F.col("at")).alias("row"), "rule").distinct()
    told = pairs.join(rules.select("rule", "category", "ord", "regex"), "rule").join(hays.select("row", "hay"), "row")
    return told.where(F.rlike("hay", F.col("regex"))).select("row", "category", "ord", F.lit(1).cast("long").alias("kw"))


def host_suffixes(host: Column) -> Column:
    """A host and all that follows one of its dots."""
    parts = F.split(host, r"\.", -1)
    return F.transform(parts, lambda _, k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))


def domain_hits(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, category, ord) of every domain rule that a host of the row (row, hosts) equals or lies under."""
    every = F.array_distinct(F.flatten(F.transform("hosts", host_suffixes)))
    keys = hosts.select("row", F.explode(every).alias("pattern"))
    return keys.join(rules.filter("kind = 'dom'").select("rule", "category", "ord", "pattern"), "pattern").drop("pattern")


def category_points(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``rules.category_points`` (id, category, ord, kw_points, dom_points, score), for a rule table of any size."""
    table = compiled(rules)
    keyed = written(R.with_hay(posts).select("id", F.monotonically_increasing_id().alias("row"),
                                             F.col("_hay").alias("hay"), F.col("_hosts").alias("hosts")))
    return _points(keyed, table).drop("row")


def _points(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """row, id and points of the haystacks and hosts of ``keyed``."""
    words = table.filter("kind = 'kw'")
    hays, keyed_rules = keyed.select("row", "hay"), words.filter("keys is not null")
    cols = ["row", "category", "ord", "kw"]
    indexed = decided_hits(hays, keyed_rules.filter("decided")).select(cols)
    if not keyed_rules.filter("not decided").isEmpty():
        indexed = indexed.unionByName(undecided_hits(hays, keyed_rules.filter("not decided")).select(cols))
    domains = domain_hits(keyed.select("row", "hosts"), table)
    zero = F.lit(0)
    hits = indexed.select("row", "category", "ord", (F.col("kw") * R.KW_POINTS).alias("kw"), zero.alias("dom")).unionByName(
        domains.select("row", "category", "ord", zero.alias("kw"), F.lit(R.DOMAIN_POINTS).alias("dom")))
    rest = [tuple(r) for r in words.filter("keys is null").select("category", "ord", "pattern").collect()]
    if rest:  # patterns without a literal: configuration, evaluated as expressions
        each = F.array([F.struct(F.lit(c).alias("category"), F.lit(o).alias("ord"),
                                 F.col("hay").rlike(R.spark_regex(p)).cast("int").alias("kw")) for c, o, p in rest])
        plain = keyed.select("row", F.inline(each)).filter("kw > 0").withColumn("dom", zero)
        hits = hits.unionByName(plain.select(hits.columns))
    points = hits.groupBy("row", "category", "ord").agg(F.sum("kw").alias("kw_points"), F.sum("dom").alias("dom_points"))
    return (points.join(keyed.select("row", "id"), "row")
            .select("row", "id", "category", "ord", F.col("kw_points").cast("int").alias("kw_points"),
                    F.col("dom_points").cast("int").alias("dom_points"))
            .withColumn("score", F.col("kw_points") + F.col("dom_points")))


def categorize(posts: DataFrame, rules: DataFrame, out: str = "categories") -> DataFrame:
    """As ``rules.categorize``: the matching category names, best first, beside each post."""
    table = compiled(rules)
    keyed = written(R.with_hay(posts).select(
        F.struct([F.col(f"`{c}`") for c in posts.columns]).alias("post"), "id", F.monotonically_increasing_id().alias("row"),
        F.col("_hay").alias("hay"), F.col("_hosts").alias("hosts")))
    ranked = _points(keyed.drop("post"), table).groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("neg"), "ord", "category"))).alias("ranked"))
    names = F.coalesce(F.transform("ranked", lambda x: x["category"]), F.array().cast("array<string>"))
    found = keyed.select("row", "post").join(ranked, "row", "left")
    return found.select(*[F.col("post").getField(c).alias(c) for c in posts.columns if c != out], names.alias(out))
