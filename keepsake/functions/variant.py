"""VARIANT helpers that spell Python's dict/``or`` semantics over parsed JSON.

* ``vget(v, "$.k")``  — the value (NULL when the key is missing; a JSON null
  stays a variant null, so presence and null are distinguishable).
* ``truthy(v)``       — Python truthiness: null, "", 0, false, [] and {} are
  falsy.
* ``first_truthy(*vs)`` — ``a or b or ...`` (NULL when none is truthy).

Object/array tests cast to ``map``/``array`` (shallow) instead of computing
``schema_of_variant`` (which walks the whole nested value).  Pass column
references, not deep expressions: each helper mentions its argument a few
times, so nesting helpers multiplies expression size — stage intermediate
values as columns instead (see ``operators.normalize``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FALSY_SCALARS = ("null", '""', "false")


def vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(_map(v).isNotNull(), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(_arr(v).isNotNull(), F.lit(False))


def kind(v: Column) -> Column:
    """'OBJECT', 'ARRAY', 'STRING', 'BOOLEAN', 'NUMBER', 'NULL' or NULL (missing)."""
    j = F.to_json(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(is_object(v), F.lit("OBJECT"))
            .when(is_array(v), F.lit("ARRAY"))
            .when(j == "null", F.lit("NULL"))
            .when(j.isin("true", "false"), F.lit("BOOLEAN"))
            .when(j.startswith('"'), F.lit("STRING"))
            .otherwise(F.lit("NUMBER")))


def as_array(v: Column) -> Column:
    """array<variant> of an ARRAY value, else empty."""
    return F.coalesce(_arr(v), F.array().cast("array<variant>"))


def obj(v: Column) -> Column:
    """The value when it is an object, else NULL (``x or {}`` then ``.get``)."""
    return F.when(is_object(v), v)


def _scalar_truthy(v: Column) -> Column:
    j = F.to_json(v)
    zero = (~j.startswith('"')) & (F.try_variant_get(v, "$", "double") == 0)
    return ~j.isin(*_FALSY_SCALARS) & ~F.coalesce(zero, F.lit(False))


def truthy(v: Column) -> Column:
    m = _map(v)
    a = _arr(v)
    return F.coalesce(
        F.when(v.isNull(), F.lit(False))
        .when(m.isNotNull(), F.size(m) > 0)
        .when(a.isNotNull(), F.size(a) > 0)
        .otherwise(_scalar_truthy(v)),
        F.lit(False))


def first_truthy(*vs: Column) -> Column:
    return F.coalesce(*[F.when(truthy(v), v) for v in vs])


def text(v: Column) -> Column:
    """Python ``str(value)`` for scalars (strings as-is, numbers as JSON text)."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def str_or(v: Column, default: str = "") -> Column:
    """``d.get(k, default)`` for a string field: missing -> default, JSON
    null -> NULL, a string as-is, other scalars as text."""
    return F.when(v.isNull(), F.lit(default)).when(F.to_json(v) == "null", F.lit(None).cast("string")).otherwise(
        text(v))


def str_list(v: Column) -> Column:
    """A list of strings (``x or []``); non-string items as text."""
    return F.transform(as_array(v), lambda x: text(x))
