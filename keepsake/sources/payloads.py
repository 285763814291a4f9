"""Raw capture payloads: every ``tweet_results.result`` object at any depth.

VARIANT stores object keys sorted, which would lose the first-appearance order
between sibling keys that first-wins de-duplication depends on.  ``extract_results``
walks a payload in a small Python UDTF, applied with a lateral join, one payload per
row, so payloads spread over all tasks; it serves streams too.  ``expand_results``
does the same with native expressions, a level of each payload after the other.  The
normalisation of each result is native (see ``operators.normalize``).
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from keepsake.functions.variant import is_array, is_object
from keepsake.session import written


# Not by Arrow: its batches hold 10,000 payloads whatever their size, pickled ones a hundred.
@udtf(returnType="pos: int, result: string", useArrow=False)
class TweetResults:
    """(pos, result JSON) for each ``tweet_results.result`` object in
    pre-order; unparseable payloads yield nothing."""

    def eval(self, payload: str):
        if payload is None:
            return
        try:
            data = json.loads(payload)
        except ValueError:
            return
        pos = 0
        stack = [data]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                tw = node.get("tweet_results")
                if isinstance(tw, dict) and isinstance(tw.get("result"), dict):
                    yield pos, json.dumps(tw["result"], ensure_ascii=False)
                    pos += 1
                children = list(node.values())
            else:
                children = node if isinstance(node, list) else []  # the payload may be a bare value
            stack.extend(c for c in reversed(children) if isinstance(c, (dict, list)))


def extract_results(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Add (pos, result) rows for each payload row (lateral join)."""
    from keepsake.session import ship_package
    ship_package(payloads.sparkSession)
    return payloads.lateralJoin(TweetResults(F.col(value).outer()))


#: Key of the objects that are looked for.
HOLDER = "tweet_results"
#: Levels of containers that are expanded before what is left is written.
LEVELS = 12


def _escaped(raw):
    """Whether a text holds escapes of ASCII characters, which may spell any key."""
    return reduce(or_, (raw.contains(f"\\u00{d}") for d in "234567"))


def _leads(raw):
    """Whether a result may lie in a container of this text, of a payload with or without such escapes."""
    return raw.contains(f'"{HOLDER}"') | (F.col("escaped") & _escaped(raw))


def _kind(v):
    """The bracket that a VARIANT begins with, null if it is no container."""
    return F.when(is_object(v), F.lit("{")).when(is_array(v), F.lit("["))


def _children(raw, kind):
    """(key, raw JSON, kind) of the members or elements of a container that may lead to results, in document order.

    One parse gives the children as texts, members in order.  A string that looks like a
    container with the key has its quotes escaped; only where such are, a second parse
    tells by VARIANTs which children are containers.  Both are made once a container, not
    once a child.
    """
    none = F.lit(None).cast("string")
    texts = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("raw")))
    items = F.transform(F.from_json(raw, "array<string>"), lambda x: F.struct(none.alias("key"), x.alias("raw")))

    def kinds(children, kind):
        return F.transform(children, lambda c: F.struct(*[c[n].alias(n) for n in ("key", "raw")], kind(c["raw"]).alias("kind")))

    def told(children, variants):
        return F.zip_with(children, variants, lambda c, v: F.struct(
            *[c[n].alias(n) for n in ("key", "raw")], _kind(v).alias("kind")))

    def first(text):
        mark = F.substring(text, 1, 1)
        return F.when(mark.isin("{", "["), mark)
    is_map = kind == "{"
    unsure = F.col("escaped") | F.col("quoted")
    every = (F.when(unsure & is_map, told(texts, F.map_values(F.from_json(raw, "map<string,variant>"))))
             .when(unsure, told(items, F.from_json(raw, "array<variant>")))
             .when(is_map, kinds(texts, first)).otherwise(kinds(items, first)))
    return F.filter(every, lambda c: c["kind"].isNotNull() & (_leads(c["raw"]) | F.coalesce(c["key"] == HOLDER, F.lit(False))))


def _expanded(nodes):
    """A level further: nodes (kind, raw) are results, of no kind, or containers; of each its result, then what may lead to more."""
    def node(kind, raw):
        return F.struct(kind.alias("kind"), raw.alias("raw"))

    def below(children):
        held = F.filter(children, lambda c: F.coalesce(c["key"] == HOLDER, F.lit(False)) & (c["kind"] == "{") & is_object(
            F.try_variant_get(F.try_parse_json(c["raw"]), "$.result", "variant")))
        return F.concat(
            F.transform(held, lambda c: node(F.lit(None).cast("string"), F.get_json_object(c["raw"], "$.result"))),
            F.transform(F.filter(children, lambda c: _leads(c["raw"])), lambda c: node(c["kind"], c["raw"])))
    return F.flatten(F.transform(nodes, lambda n: F.when(n["kind"].isNull(), F.array(node(n["kind"], n["raw"]))).otherwise(
        F.flatten(F.transform(F.array(_children(n["raw"], n["kind"])), below)))))  # so that children are made once


def expand_results(payloads: DataFrame, value: str = "value") -> DataFrame:
    """As :func:`extract_results` without Python: containers are expanded level by level.

    Each level keeps only containers whose text names the key (or has escapes that may), so a level costs what is
    left of the payloads above their results; there are as many levels as the deepest
    result has containers above it.  A payload stays in its row, as the list of what is left of it in document order, so
    its results come out in pre-order and nothing is exchanged.  For batch data: ``LEVELS`` levels are one step
    over the payloads, written once; only payloads that are deeper take another.

    Of a payload with members given twice nothing is found.
    """
    names = payloads.columns
    raw = F.col("row").getField(value)
    base = payloads.select(F.struct([F.col(f"`{c}`") for c in names]).alias("row"))
    marks = [_escaped(raw).alias("escaped"), raw.contains(HOLDER + "\\").alias("quoted")]  # looked for once a payload
    level = base.select("row", *marks, raw.alias("raw"), _kind(F.try_parse_json(raw)).alias("kind")).where(
        F.col("kind").isNotNull() & _leads(F.col("raw"))).select("row", "escaped", "quoted", F.array(F.struct("kind", "raw")).alias("nodes"))
    open_ = F.exists("nodes", lambda n: n["kind"].isNotNull())
    found = []
    while True:
        for _ in range(LEVELS):  # a generator keeps the levels' expressions apart: in one another they cost planning time and stack
            level = level.select("row", "escaped", "quoted", F.explode(F.array(_expanded(F.col("nodes")))).alias("nodes"))
        level = written(level)
        found.append(level.where(~open_).select("row", F.posexplode("nodes").alias("pos", "node")))
        level = level.where(open_)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).select(
                *[F.col("row").getField(c).alias(c) for c in names], "pos", F.col("node.raw").alias("result"))
