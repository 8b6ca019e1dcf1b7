"""Requests over one collection: filter, order, limit, aggregates, text, exact or approximate vectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidQuery
from orrery.functions import ids, vectors
from orrery.operators import filters, ranking
from orrery.operators.filters import Filter
from orrery.operators.ivf import Index
from orrery.operators.textindex import TextIndex

MAX_QUERIES = 16


@dataclass(frozen=True)
class Query:
    """``order_by`` is ``(column or None for the id, descending)``; ``aggregates`` hold ``"Count"`` and ``("Sum", column)``.

    ``text`` is ``{column, query, k, params}``; ``exact_vector`` and ``approx_vector`` are ``{column, vector, k, metric, probes}``.
    """

    filter: Filter | None = None
    order_by: tuple[str | None, bool] | None = None
    limit: int | None = None
    aggregates: tuple[Any, ...] = ()
    text: dict | None = None
    exact_vector: dict | None = None
    approx_vector: dict | None = None

    @staticmethod
    def parse(body: dict) -> Query:
        order = body.get("order_by")
        target = order and order["target"]
        by = None if not order else (target["Attribute"] if isinstance(target, dict) else None, order.get("direction", "Asc") == "Desc")
        aggregates = tuple("Count" if a == "Count" else ("Sum", a["Sum"]["column"]) for a in body.get("aggregates", ()))
        return Query(filters.parse(body["filter"]) if body.get("filter") else None, by, body.get("limit"), aggregates, body.get("text"), body.get("exact_vector"), body.get("approx_vector"))


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    aggregates: DataFrame | None = None
    notes: dict = field(default_factory=dict)


def aggregate(df: DataFrame, wanted: tuple[Any, ...]) -> DataFrame:
    """One row: ``count``, and ``sum_x`` with ``sum_x_values`` for each sum; nothing sums to 0.0."""
    cols = []
    for a in wanted:
        if a == "Count":
            cols.append(F.count(F.lit(1)).alias("count"))
            continue
        name = a[1]
        if name in df.columns and not isinstance(df.schema[name].dataType, T.NumericType):
            # an error only if some row has the value
            bad = F.max(F.when(F.col(name).isNotNull(), F.raise_error(F.lit(f"{name} is not numeric")).cast("double")))
            cols += [F.count(name).alias(f"sum_{name}_values"), F.coalesce(bad, F.lit(0.0)).alias(f"sum_{name}")]
        elif name in df.columns:
            cols += [F.count(name).alias(f"sum_{name}_values"), F.coalesce(F.sum(F.col(name).cast("double")), F.lit(0.0)).alias(f"sum_{name}")]
        else:
            cols += [F.lit(0).cast("long").alias(f"sum_{name}_values"), F.lit(0.0).alias(f"sum_{name}")]
    return df.agg(*cols)


@dataclass(frozen=True)
class Indexes:
    """What a snapshot has beside its rows: by column the stored vector and text indexes and the vectors' default metrics; ``fresh`` and ``gone`` are the rows
    written, and the ids written or deleted, since the vector indexes were published.  A text index is given only where it is of the snapshot itself."""

    vector: dict[str, Index] = field(default_factory=dict)
    text: dict[str, TextIndex] = field(default_factory=dict)
    metric: dict[str, str] = field(default_factory=dict)
    dims: dict[str, int] = field(default_factory=dict)
    fresh: DataFrame | None = None
    gone: DataFrame | None = None


def execute(df: DataFrame, id_col: str, q: Query, indexes: Indexes = Indexes()) -> Result:
    """The request's rows and aggregates.

    Text is scored from the column's index if there is one.  An approximate search without aggregates or an order goes by the column's index and is
    answered exactly without one, or where its filter compares whole arrays.
    """
    if q.exact_vector and q.approx_vector:
        raise InvalidQuery("exact and approximate vectors exclude each other")
    if q.text and (q.exact_vector or q.approx_vector):
        raise InvalidQuery("text and vectors need two queries")
    if q.text and q.order_by:
        raise InvalidQuery("text is ordered by its score")
    limit = ranking.MAX_RESULTS if q.limit is None else q.limit
    if not 0 <= limit <= ranking.MAX_RESULTS:
        raise InvalidQuery(f"the limit lies between 0 and {ranking.MAX_RESULTS}")
    kept = df if q.filter is None else df.where(filters.compile_filter(q.filter, df.schema))
    if q.text:
        t = q.text
        ranking.check_k(t["k"])
        index = indexes.text.get(t["column"])
        best = None if q.aggregates else min(t["k"], limit)
        hits = ranking.bm25(df, id_col, t["column"], t["query"], ranking.Bm25(**t.get("params", {})), q.filter, index, best)
        totals = aggregate(df.join(hits.select(id_col), id_col, "left_semi"), q.aggregates) if q.aggregates else None
        return Result(ranking.top(hits, id_col, t["k"], limit).join(df, id_col), totals, index.notes if index else {})
    if v := q.exact_vector or q.approx_vector:
        column = v["column"]
        ranking.check_k(v["k"])
        if column not in df.columns or not isinstance(df.schema[column].dataType, T.ArrayType) or not isinstance(df.schema[column].dataType.elementType, T.FractionalType):
            raise InvalidQuery(f"no vector column {column}")
        metric = v.get("metric") or indexes.metric.get(column, "cosine")
        vectors.check(v["vector"], None, metric)
        dim = indexes.dims.get(column)
        if dim is None:  # any row's: a collection knows it from its schema
            some = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
            dim = some and some[0]
        vectors.check(v["vector"], dim, metric)
        totals = aggregate(kept, q.aggregates) if q.aggregates else None
        index = indexes.vector.get(column)
        if q.approx_vector and index is not None and not q.aggregates and not q.order_by and not filters.whole_arrays(q.filter):
            if metric == "l2" and q.filter is None and indexes.gone is None:
                scored = index.search_l2(v["vector"], min(v["k"], max(limit, 1)), v.get("probes"))
            else:
                scored = index.search(v["vector"], metric, v.get("probes"), q.filter, indexes.fresh, indexes.gone)
        else:
            scored = ranking.knn(kept, id_col, column, v["vector"], metric)
        return Result(ranking.top(scored, id_col, v["k"], limit).join(df, id_col), totals)
    return Result(ordered(kept, id_col, q.order_by).limit(limit), aggregate(kept, q.aggregates) if q.aggregates else None)


def ordered(df: DataFrame, id_col: str, by: tuple[str | None, bool] | None) -> DataFrame:
    """By id, or by an attribute: missing values last either way, ties by ascending id."""
    column, down = by or (None, False)
    if column is None:
        return df.orderBy(*(ids.descending(df, id_col) if down else ids.ascending(df, id_col)))
    if column not in df.columns:
        return df.orderBy(*ids.ascending(df, id_col))
    x = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        x = F.when(x.isNotNull(), F.raise_error(F.lit(f"{column} holds arrays")).cast("int"))
    return df.orderBy(x.desc_nulls_last() if down else x.asc_nulls_last(), *ids.ascending(df, id_col))


def multi(df: DataFrame, id_col: str, queries: list[Query], indexes: Indexes = Indexes()) -> list[Result]:
    """Up to 16 requests over one snapshot."""
    if not 1 <= len(queries) <= MAX_QUERIES:
        raise InvalidQuery(f"between 1 and {MAX_QUERIES} queries")
    return [execute(df, id_col, q, indexes) for q in queries]
