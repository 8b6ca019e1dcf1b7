"""Boolean filters over attributes, compiled to one Column.

Logic is two-valued: a predicate on a missing attribute is false, so its negation is true.  A filter is
compiled with a polarity; negation goes down to the leaves, where the complement adds ``IS NULL OR``, so that
WHERE needs no coalesce and comparisons still reach the Parquet scan.  Literals of a kind that can't be
compared with a column make the leaf false when the plan is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidQuery


class Filter:
    """``&``, ``|`` and ``~`` put filters together."""

    def __and__(self, other: Filter) -> Filter:
        return And((self, other))

    def __or__(self, other: Filter) -> Filter:
        return Or((self, other))

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Eq(Filter):
    column: str
    value: Any


@dataclass(frozen=True)
class Range(Filter):
    """Bounds are ``(value, inclusive)``; without bounds the attribute need only be there (an array: not empty)."""

    column: str
    lower: tuple[Any, bool] | None = None
    upper: tuple[Any, bool] | None = None


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


def eq(column: str, value: Any) -> Filter:
    return Eq(column, value)


def gte(column: str, value: Any) -> Filter:
    return Range(column, (value, True))


def gt(column: str, value: Any) -> Filter:
    return Range(column, (value, False))


def lte(column: str, value: Any) -> Filter:
    return Range(column, None, (value, True))


def lt(column: str, value: Any) -> Filter:
    return Range(column, None, (value, False))


def between(column: str, low: Any, high: Any) -> Filter:
    """``low <= column < high``."""
    return Range(column, (low, True), (high, False))


def present(column: str) -> Filter:
    return Range(column)


def parse(node: dict) -> Filter:
    """A filter from its JSON form, such as ``{"And": [{"Eq": {"column": "lang", "value": "en"}}, ...]}``."""
    if not isinstance(node, dict) or len(node) != 1:
        raise InvalidQuery(f"a filter is an object with one key: {node!r}")
    ((kind, body),) = node.items()
    if kind == "Eq":
        return Eq(body["column"], body["value"])
    if kind == "Range":
        return Range(body["column"], *(_bound(body.get(k)) for k in ("lower", "upper")))
    if kind in ("And", "Or"):
        return {"And": And, "Or": Or}[kind](tuple(map(parse, body)))
    if kind == "Not":
        return Not(parse(body))
    raise InvalidQuery(f"unknown filter {kind}")


def _bound(body: dict | None) -> tuple[Any, bool] | None:
    if body is None or body == "Unbounded":
        return None
    ((kind, value),) = body.items()
    if kind not in ("Included", "Excluded"):
        raise InvalidQuery(f"unknown bound {kind}")
    return value, kind == "Included"


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, (list, tuple)) else "null"


def _column_kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "string" if isinstance(t, T.StringType) else "bool" if isinstance(t, T.BooleanType) else "other"


def _literal(value: Any, t: T.DataType) -> Column:
    # a whole float goes to an integer column as an integer, which the scan can use
    if isinstance(value, float) and isinstance(t, T.IntegralType) and value.is_integer() and abs(value) < 2**53:
        return F.lit(int(value))
    return F.lit(value)


def _comparable(value: Any, t: T.DataType) -> bool:
    """Of one kind, and a number that a column can hold: NaN equals nothing, and no value has more than 64 bits."""
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return False
    return _kind(value) == _column_kind(t) and not (isinstance(value, float) and math.isnan(value))


def _inside(x: Column, t: T.DataType, f: Range) -> Column | None:
    parts = []
    for bound, low in ((f.lower, True), (f.upper, False)):
        if bound is not None:
            if not _comparable(bound[0], t):
                return None
            v = _literal(bound[0], t)
            parts.append((x >= v if bound[1] else x > v) if low else (x <= v if bound[1] else x < v))
    return reduce(lambda a, b: a & b, parts)


def _leaf(f: Eq | Range, schema: T.StructType) -> Column | None:
    """Null for null, or None where the leaf can't be true."""
    if f.column not in schema.fieldNames():
        return None
    t, x = schema[f.column].dataType, F.col(f.column)
    array = isinstance(t, T.ArrayType)
    if isinstance(f, Eq):
        if _kind(f.value) == "array":
            if not array or not all(_comparable(v, t.elementType) and (isinstance(v, float) == isinstance(t.elementType, T.FractionalType)) for v in f.value):
                return None
            return x == (F.array(*map(F.lit, f.value)) if f.value else F.array()).cast(t)
        if array:
            return F.exists(x, lambda e: e == _literal(f.value, t.elementType)) if _comparable(f.value, t.elementType) else None
        return x == _literal(f.value, t) if _comparable(f.value, t) else None
    if f.lower is None and f.upper is None:
        return F.size(x) > 0 if array else x.isNotNull()
    if array:
        if _inside(F.lit(None).cast(t.elementType), t.elementType, f) is None:
            return None
        return F.exists(x, lambda e: _inside(e, t.elementType, f))  # both bounds on one element
    return _inside(x, t, f)


def compile_filter(f: Filter, schema: T.StructType, negated: bool = False) -> Column:
    """A Column for WHERE: true where the filter holds, false or null where it doesn't."""
    if isinstance(f, Not):
        return compile_filter(f.part, schema, not negated)
    if isinstance(f, (And, Or)):
        conjunction = isinstance(f, And) != negated
        parts = [compile_filter(p, schema, negated) for p in f.parts]
        return reduce((lambda a, b: a & b) if conjunction else (lambda a, b: a | b), parts, F.lit(conjunction)) if not parts else reduce((lambda a, b: a & b) if conjunction else (lambda a, b: a | b), parts)
    leaf = _leaf(f, schema)
    if leaf is None:
        return F.lit(negated)
    if not negated:
        return leaf
    x = F.col(f.column)
    if isinstance(f, Range) and f.lower is None and f.upper is None and not isinstance(schema[f.column].dataType, T.ArrayType):
        return x.isNull()
    if isinstance(schema[f.column].dataType, T.ArrayType):
        return x.isNull() | ~F.coalesce(leaf, F.lit(False))
    return x.isNull() | ~leaf


def flag(f: Filter, schema: T.StructType) -> Column:
    """The filter as a value to project, true or false."""
    return F.coalesce(compile_filter(f, schema), F.lit(False))


def whole_arrays(f: Filter | None) -> bool:
    """Whether some part of the filter compares a whole array."""
    if isinstance(f, Not):
        return whole_arrays(f.part)
    if isinstance(f, (And, Or)):
        return any(map(whole_arrays, f.parts))
    return isinstance(f, Eq) and _kind(f.value) == "array"
