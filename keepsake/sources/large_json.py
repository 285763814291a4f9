"""JSON documents of any size, read by many tasks: the elements of a file's top-level list or members.

A file that holds one JSON document has no safe place to cut it: a comma or a bracket
means something else inside a string, and nesting decides which commas separate items.
Both are prefix sums.  The file is read as text "lines" that end at commas, so Spark
splits it as it splits any text:

1. Each split reports whether it holds an odd number of quotes, and, for both answers
   to "does it begin inside a string?", which brackets it closes and leaves open.
2. Put together in file order, these few numbers per split give the exact state in which each
   split begins (in a string or not, open brackets).
3. Each split cuts its text where, given that state, an item ends, and numbers the
   pieces.  A piece that no cut ends goes on in the next split: such pieces carry the
   same number there and are joined by it; all others pass as they are.

Items are the elements of a top-level list; for a top-level object the members, and
the elements of a member that is a list.  Each has its text, so whoever needs it
parses it alone.  An item must fit into a row, a document needn't.

A file that is certainly one split (no larger than what Spark counts for opening a file) needs none of
that: it begins outside of everything, and its end is checked by the task that cuts it.
Many small files share a task.

The driver holds one short row per split (128 MB of text by default) of the others.

Defined results: a file that begins with neither a list nor an object gives no items;
a document that ends in a string or with open brackets, and text where an item should
be but isn't, are errors with the path; an empty list has its member's row alone; of
repeated members all are given, in order of ``member``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.core import strip_ws
from keepsake.session import ship_package, written
from keepsake.sources.files import path_list

#: Bytes from which on a file is read by :func:`elements` instead of as one row.
LARGE = 64 << 20
BROKEN = "not one valid JSON document: "
_ESCAPE = re.compile(rb"\\.", re.S)
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARK = _STEP != 0
_MARK[ord(",")] = True
#: What a piece lies between: begin of file, brackets and commas of a list, of an object, of a member's list; end.
START, LIST, ITEM, OBJECT, MEMBER, INNER, INNER_ITEM, INNER_END, END = "^", "[", "i", "{", "m", "a", "e", "z", "E"
AFTER_END = "$"


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places of brackets and commas, those characters, whether an odd number of quotes stands before each, and in all)."""
    plain = np.frombuffer(_ESCAPE.sub(b"xx", text), np.uint8)
    quotes = np.flatnonzero(plain == 34)
    at = np.flatnonzero(_MARK[plain])
    return at, plain[at], np.searchsorted(quotes, at) % 2 == 1, len(quotes) % 2 == 1


def left_open(chars: np.ndarray) -> tuple[int, bytes]:
    """(brackets closed that were open before, brackets left open) of a row of brackets and commas."""
    step = _STEP[chars].astype(np.int64)
    depth = np.cumsum(step)
    if not len(depth):
        return 0, b""
    lowest_after = np.minimum.accumulate(depth[::-1])[::-1]
    return max(0, -int(depth.min())), chars[(step == 1) & (lowest_after >= depth)].tobytes()


def followed(a: tuple[int, bytes], b: tuple[int, bytes]) -> tuple[int, bytes]:
    """What two stretches of text do to the open brackets, one after the other."""
    (close, opened), (more, then) = a, b
    if more <= len(opened):
        return close, opened[:len(opened) - more] + then
    return close + more - len(opened), then


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], tuple[int | None, bool], bytes]]:
    """(path and first byte of the split, given and alone of its file, text): the pieces between commas put together again, batch by batch."""
    seen = None
    for b in batches:
        paths, starts = b.column("path").to_pylist(), b.column("block").to_pylist()
        values = b.column("value").cast(pa.binary()).to_pylist()
        at = 0
        while at < len(values):
            upto = at
            while upto < len(values) and (paths[upto], starts[upto]) == (paths[at], starts[at]):
                upto += 1
            here = (paths[at], starts[at])
            # a comma stands before every piece but a file's first
            first = b"" if here != seen and starts[at] == 0 else b","
            yield here, (b.column("given")[at].as_py(), b.column("alone")[at].as_py()), first + b",".join(values[at:upto])
            seen, at = here, upto


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(place, begin, odd, sides):
        return pa.RecordBatch.from_pylist([{
            "path": place[0], "block": place[1], "begin": begin, "odd": odd, "closed": [s[0] for s in sides],
            "opened": [s[1].decode() for s in sides]}], schema=_SUMMARY)
    here, begin, odd, sides = None, "", False, []
    for place, _, text in _splits(batches):
        if place != here:
            if here is not None:
                yield row(here, begin, odd, sides)
            here, begin, odd, sides = place, "", False, [(0, b""), (0, b"")]
        begin = begin or text.lstrip(_BLANK)[:1].decode("ascii", "replace")
        _, chars, inside, more = marks(text)
        sides = [followed(s, left_open(chars[inside == (odd != begins)])) for s, begins in zip(sides, (False, True))]
        odd = odd != more
    if here is not None:
        yield row(here, begin, odd, sides)


_BLANK = b" \t\r\n\xef\xbb\xbf"
_SUMMARY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("begin", pa.string()), ("odd", pa.bool_()),
                      ("closed", pa.list_(pa.int64())), ("opened", pa.list_(pa.string()))])
_PIECE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("members", pa.int64()),
                    ("after", pa.string()), ("before", pa.string()), ("text", pa.string()), ("given", pa.int64()),
                    ("alone", pa.bool_())])


def begin_states(summaries) -> dict[tuple[str, int], tuple[bool, bytes]]:
    """(path, block) -> (begins in a string, open brackets), from the splits' summaries; files of plain text are left out."""
    out, path, inside, stack = {}, None, False, b""
    first = {}
    for s in sorted(summaries, key=lambda s: (s["path"], s["block"])):
        first.setdefault(s["path"], s["begin"])
        if first[s["path"]] not in ("[", "{"):
            continue
        if s["path"] != path:
            _must_end(path, inside, stack)
            path, inside, stack = s["path"], False, b""
        out[s["path"], s["block"]] = (inside, stack)
        closed, opened = s["closed"][inside], s["opened"][inside].encode()
        if closed > len(stack):
            raise ValueError(BROKEN + path)
        stack = stack[:len(stack) - closed] + opened
        inside = inside != s["odd"]
    _must_end(path, inside, stack)
    return out


def _must_end(path: str | None, inside: bool, stack: bytes) -> None:
    if path is not None and (inside or stack):
        raise ValueError(BROKEN + path)


class _Cutter:
    """Cuts one split's text into pieces, given the state in which it begins."""

    def __init__(self, place: tuple[str, int], state: tuple[bool, bytes], given: int | None = None, alone: bool = False):
        self.path, self.block = place
        self.given, self.alone = given, alone
        self.inside, self.stack = state
        self.k = self.members = 0
        self.after = START if self.block == 0 else None
        self.parts: list[bytes] = []

    def cuts(self, at: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Places at which pieces end, and what stands there."""
        step = _STEP[chars].astype(np.int64)
        depth = len(self.stack) + np.cumsum(step)
        opens, closes, comma = step == 1, step == -1, step == 0
        top = self.stack[:1] or chars[opens][:1].tobytes()
        kind = np.full(len(at), "", dtype="U1")
        kind[opens & (depth == 1)] = LIST if top == b"[" else OBJECT
        kind[closes & (depth == 0)] = END
        kind[comma & (depth == 1)] = ITEM if top == b"[" else MEMBER
        if top == b"{":
            second = opens & (depth == 2)
            last = np.maximum.accumulate(np.where(second, np.arange(len(at)), -1))
            in_list = np.where(last >= 0, chars[last] == ord("["), self.stack[1:2] == b"[")
            kind[second & (chars == ord("["))] = INNER
            kind[comma & (depth == 2) & in_list] = INNER_ITEM
            kind[closes & (depth == 1) & (chars == ord("]"))] = INNER_END
        there = np.flatnonzero(kind != "")
        return at[there], kind[there].tolist()

    def feed(self, text: bytes) -> Iterator[dict]:
        at, chars, odd, more = marks(text)
        real = odd == self.inside
        at, chars = at[real], chars[real]
        places, kinds = self.cuts(at, chars)
        begin = 0
        for place, kind in zip(places.tolist(), kinds):
            self.parts.append(text[begin:place])
            yield self._piece(kind)
            begin, self.after = place + 1, kind
            self.k += 1
            self.members += kind in (ITEM, MEMBER)
        self.parts.append(text[begin:])
        closed, opened = left_open(chars)
        if closed > len(self.stack):
            raise ValueError(BROKEN + self.path)
        self.stack = self.stack[:len(self.stack) - closed] + opened
        self.inside = self.inside != more

    def _piece(self, before: str | None) -> dict:
        text, self.parts = b"".join(self.parts), []
        return {"path": self.path, "block": self.block, "k": self.k, "members": self.members, "after": self.after,
                "before": before, "text": text.decode(), "given": self.given, "alone": self.alone}

    def rest(self) -> dict:
        if self.alone:
            _must_end(self.path, self.inside, self.stack)
        return self._piece(AFTER_END if self.alone else None)


def _pieces(states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, here, rows, size, blank = None, None, [], 0, b""
        for place, (given, alone), text in _splits(batches):
            if place != here:
                if cutter is not None:
                    rows.append(cutter.rest())
                cutter, here, blank = None, place, b""
                if not alone and place in states.value:
                    cutter = _Cutter(place, states.value[place], given)
            if alone and cutter is None and blank is not None:
                text = blank + text
                begin = text.lstrip(_BLANK)[:1]
                # a file of plain text is left out; of one that begins with blanks more is to be seen
                cutter = _Cutter(place, (False, b""), given, True) if begin in (b"[", b"{") else None
                blank = None if begin else text
            if cutter is None:
                continue
            rows.extend(cutter.feed(text))
            size += len(text)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)
                rows, size = [], 0
        if cutter is not None:
            rows.append(cutter.rest())
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)
    return run


def _alone(spark: SparkSession) -> int:
    """Bytes up to which a file is never split by Spark's readers."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def _tasks(spark: SparkSession, paths) -> int:
    """Tasks for the text under some paths by its size: small files count by their bytes here, not by those for opening them."""
    size = sum(int(spark.read.text(p)._jdf.queryExecution().analyzed().stats().sizeInBytes()) for p in path_list(paths))
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // most))


def large_text(spark: SparkSession, paths, sep: str, least: int = 0) -> DataFrame:
    """The text between separators, of files of at least ``least`` bytes: paths and folders as given, not a list of files."""
    read = spark.read.option("lineSep", sep)
    frames = [read.text(p).where(F.col("_metadata.file_size") >= least) for p in path_list(paths)] if least else [read.text(paths)]
    return reduce(DataFrame.unionByName, [f.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.lit(i if least else None).cast("bigint").alias("given"), F.col("_metadata.file_size").alias("size")) for i, f in enumerate(frames)])


def _fragments(spark: SparkSession, paths, least: int = 0) -> DataFrame:
    """(path, block, value, given, alone): the text between commas; a split's rows come in order, in one task."""
    return large_text(spark, paths, ",", least).select(
        "path", "block", "value", "given", (F.col("size") <= _alone(spark)).alias("alone"))


def file_list(spark: SparkSession, paths) -> DataFrame:
    """(file_ord, path, length) of the files under the given paths; their content isn't read."""
    frames = [spark.read.format("binaryFile").load(p).select(
        F.lit(i).cast("bigint").alias("file_ord"), F.col("_metadata.file_path").alias("path"), "length")
        for i, p in enumerate(path_list(paths))]
    return reduce(DataFrame.unionByName, frames)


def elements(spark: SparkSession, paths, least: int = 0, inner: bool = True) -> DataFrame:
    """(path, member, name, pos, text, given): the items of each file's document, of files of at least ``least`` bytes.

    No file may be under two of the paths if ``least`` is given (see :func:`large_files`); then ``given``
    is the number of the path that the file is under.  ``name`` is null for the elements of a top-level list, else the member's key; ``pos``
    counts the elements of a list from 0 and is null for a member itself.  A member that
    is a list has a row with null ``text``, and one per element if ``inner``.
    """
    ship_package(spark)
    fragments = _fragments(spark, paths, least)
    tasks = _tasks(spark, paths)
    states = begin_states(fragments.where("not alone").coalesce(tasks).mapInArrow(
        _summaries, "path string, block long, begin string, odd boolean, closed array<long>, opened array<string>").collect())
    told = spark.sparkContext.broadcast(states)
    pieces = written(fragments.coalesce(tasks).mapInArrow(
        _pieces(told), "path string, block long, k long, members long, after string, before string, text string, "
                       "given long, alone boolean"))
    # mine: what a later step checks, which may come before the filter on it
    cols = ["path", "e", "member", "after", "before", "text", "given", "mine"]
    placed = pieces.withColumns({"e": F.col("k"), "member": F.col("members"), "mine": F.col("alone")}).select(cols)
    if states:
        counts = pieces.where("not alone").groupBy("path", "block").agg(F.max("k").alias("cuts"), F.max("members").alias("members")).collect()
        bases = spark.createDataFrame(_bases(counts), "path string, block long, base long, member_base long")
        split = pieces.where("not alone").join(F.broadcast(bases), ["path", "block"]).select(
            "path", "block", (F.col("base") + F.col("k")).alias("e"), (F.col("member_base") + F.col("members")).alias("member"),
            "after", "before", "text", "given", "alone")
        whole = F.col("after").isNotNull() & F.col("before").isNotNull()
        across = (split.where(~whole & ~F.col("alone")).groupBy("path", "e").agg(
            F.min("member").alias("member"), F.max("after").alias("after"), F.max("before").alias("before"),
            F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("given").alias("given"))
            .withColumns({"text": F.array_join("parts.text", ""), "mine": F.lit(True)}))
        placed = placed.unionByName(split.withColumn("mine", whole & ~F.col("alone")).select(cols)).unionByName(across.select(cols))
    return _items(placed, inner)


def _bases(counts) -> list[tuple[str, int, int, int]]:
    out, path, cuts, members = [], None, 0, 0
    for c in sorted(counts, key=lambda c: (c["path"], c["block"])):
        if c["path"] != path:
            path, cuts, members = c["path"], 0, 0
        out.append((path, c["block"], cuts, members))
        cuts, members = cuts + c["cuts"], members + c["members"]
    return out


def _items(pieces: DataFrame, inner: bool = True) -> DataFrame:
    after, before, body = F.col("after"), F.col("before"), strip_ws(F.col("text"))
    blank = body == ""
    nothing = blank & ((after.isin(LIST, OBJECT) & before.eqNullSafe(END)) | ((after == INNER) & before.eqNullSafe(INNER_END)))
    outside = after.isin(START, END, INNER_END)
    bad = F.when(outside & after.isin(END, INNER_END), ~blank).when(outside, F.lit(False)).otherwise(blank & ~nothing)
    broken = F.raise_error(F.concat(F.lit(BROKEN), F.col("path"))).cast("boolean")
    # in the filter, where no later step can skip it
    checked = pieces.where(F.when(~F.col("mine"), F.lit(False)).when(F.coalesce(bad, F.lit(True)), broken).otherwise(~(outside | F.coalesce(nothing, F.lit(False)))))
    of_object = after.isin(OBJECT, MEMBER)
    opens = of_object & (before == INNER)
    one = F.concat(F.lit("{"), F.col("text"), F.when(opens, F.lit("null")).otherwise(F.lit("")), F.lit("}"))
    parsed = F.when(of_object, F.try_variant_get(F.parse_json(one), "$", "map<string,variant>"))
    rows = checked.select("path", "e", "member", "after", opens.alias("opens"), F.col("text"),
                          F.get(F.map_entries(parsed), 0).alias("entry"), "given")
    listed = F.col("after").isin(LIST, ITEM)
    items = rows.where(listed | F.col("entry").isNotNull()).select(  # elements of a list and members in one pass
        "path", F.when(listed, F.lit(0)).otherwise(F.col("member")).cast("long").alias("member"), F.col("entry.key").alias("name"),
        F.when(listed, F.col("e") - 1).alias("pos"),
        F.when(listed, F.col("text")).when(~F.col("opens"), F.to_json("entry.value")).alias("text"), "given", "e")
    # by their text: a filter on ``opens`` would be told to the check above, which then fails others
    heads = items.where("name is not null and pos is null and text is null").select("path", "member", "name", F.col("e").alias("head"))
    items = items.drop("e")
    if not inner:
        return items
    within = rows.where(F.col("after").isin(INNER, INNER_ITEM)).select("path", "member", "e", "text", "given")
    return items.unionByName(within.join(heads, ["path", "member"]).select(
        "path", "member", "name", (F.col("e") - F.col("head") - 1).alias("pos"), "text", "given"))


def large_files(spark: SparkSession, paths, least: int = LARGE) -> tuple[list[str], int] | None:
    """(paths, least) for :func:`elements` to read the files of at least ``least`` bytes once each; None if there are none.

    The paths as given, which the reader lists itself; only if some file is under two of
    them, the files, as a reader takes them.
    """
    listed = file_list(spark, paths).where(F.col("length") >= least)
    files = listed.coalesce(2 * spark.sparkContext.defaultParallelism).groupBy("path").count()  # only names and lengths
    most = files.agg(F.max("count")).first()[0]
    if most is None:
        return None
    if most == 1:
        return path_list(paths), least
    return [unquote(r["path"]) for r in files.select("path").collect()], 0  # metadata gives them encoded


__all__ = ["elements", "file_list", "large_files", "begin_states"]
