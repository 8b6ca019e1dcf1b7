"""Scores between a vector column and a query vector; higher is better."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import InvalidQuery

METRICS = ("l2", "dot", "cosine")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A vector without length is an error."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.raise_error(F.lit("cosine of a zero vector")).cast("double"))


def score(metric: str, a: Column, b: Column) -> Column:
    if metric == "l2":
        return -squared_l2(a, b)
    return dot(a, b) if metric == "dot" else cosine(a, b)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def check(vector: list[float], dim: int | None = None, metric: str = "l2") -> list[float]:
    """A query vector of finite numbers, of the column's dimensions, and for cosine of some length."""
    if metric not in METRICS:
        raise InvalidQuery(f"unknown metric {metric}")
    if not vector or any(not math.isfinite(x) for x in vector):
        raise InvalidQuery("a query vector is finite and not empty")
    if dim is not None and len(vector) != dim:
        raise InvalidQuery(f"the column has {dim} dimensions, the query {len(vector)}")
    if metric == "cosine" and not any(vector):
        raise InvalidQuery("cosine of a zero vector")
    return [float(x) for x in vector]


def literal(vector: list[float], dim: int | None = None, metric: str = "l2") -> Column:
    """The same as a column."""
    return F.array(*map(F.lit, check(vector, dim, metric)))


# ---------------------------------------------------------------- whole batches


def matrix(v: pa.Array, dim: int) -> np.ndarray:
    """A row for each vector of an Arrow batch, zeros for null; one of other dimensions is an error."""
    sizes = pc.list_value_length(v)
    if len(v) > sizes.null_count and (pc.min(sizes).as_py(), pc.max(sizes).as_py()) != (dim, dim):
        raise ValueError(f"a vector hasn't {dim} dimensions")
    out = np.zeros((len(v), dim))
    out[np.asarray(v.is_valid())] = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return out


def scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Of every row of ``x`` with every row of ``q``."""
    if metric == "dot":
        return x @ q.T
    if metric == "l2":
        # row by row, so that no difference is lost to cancellation
        return np.stack([-((x - c) ** 2).sum(1) for c in q], 1) if len(q) else np.zeros((len(x), 0))
    return (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None])


def batch_score(metric: str, vec: Column, query: list[float]) -> Column:
    """``score`` against one query, a batch of rows at a time in numpy; null for null."""
    q = np.array([check(query, None, metric)])

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        x, null = matrix(v, q.shape[1]), ~np.asarray(v.is_valid())
        if metric == "cosine":
            if (~x.any(1) & ~null).any():
                raise ValueError("cosine of a zero vector")
            x[null] = 1
        return pa.array(scores(x, q, metric)[:, 0], mask=null)

    return run(vec)


def half(vec: Column) -> Column:
    """Rounded to half precision; a number too large for it is an error."""

    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        with np.errstate(over="ignore"):
            short = flat.astype(np.float16).astype(np.float32)
        if not np.isfinite(short).all():
            raise ValueError("a number is too large for half precision")
        sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(short), mask=v.is_null())

    return run(vec)
