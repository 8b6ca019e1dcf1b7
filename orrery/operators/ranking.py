"""BM25, exact nearest neighbours and rank fusion."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidQuery
from orrery.functions import ids, text, vectors
from orrery.operators.filters import Filter, compile_filter
from orrery.operators.textindex import TextIndex

MAX_RESULTS, MAX_QUERY_BYTES = 10_000, 1_024


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    k3: float = 8.0

    def __post_init__(self) -> None:
        if not (all(map(math.isfinite, (self.k1, self.b, self.k3))) and self.k1 > 0 and 0 <= self.b <= 1 and self.k3 > 0):
            raise InvalidQuery("k1 > 0, 0 <= b <= 1 and k3 > 0 are needed")


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_RESULTS:
        raise InvalidQuery(f"k lies between 1 and {MAX_RESULTS}")


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_t", lambda t: t == term))


def bm25(df: DataFrame, id_col: str, column: str, query: str, params: Bm25 = Bm25(), keep: Filter | None = None, index: TextIndex | None = None, k: int | None = None) -> DataFrame:
    """``(id_col, score)`` of every document with a term of ``query``; statistics are those of the whole of ``df``, and ``keep`` filters after.

    With a text index of ``df`` only the query's postings are read, and without a filter only the blocks that can hold one of the best ``k``.  Without an
    index every document is split once: it counts each query term in place, and only those counts and lengths are aggregated.
    """
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise InvalidQuery(f"a text query has at most {MAX_QUERY_BYTES} bytes")
    if column not in df.columns:
        raise InvalidQuery(f"no column {column}")
    kind = df.schema[column].dataType
    if not isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.StringType):
        raise InvalidQuery(f"{column} holds no text")
    if index is not None:
        hits = index.search(query, params.k1, params.b, params.k3, k if keep is None else None).withColumnRenamed("id", id_col)
        return hits if keep is None else hits.join(df.where(compile_filter(keep, df.schema)).select(id_col), id_col, "left_semi")
    terms = list(Counter(text.tokenize_query(df.sparkSession, query)).items())  # added in the query's order, as an index adds them
    if not terms:
        return df.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    kept = compile_filter(keep, df.schema) if keep is not None else F.lit(True)
    counted = text.token_rows(df, id_col, column, F.coalesce(kept, F.lit(False)).alias("_kept")).where(F.size("_t") > 0)
    tf = [_occurrences(w).alias(f"_tf{i}") for i, (w, _) in enumerate(terms)]
    rows = counted.select(id_col, "_kept", F.size("_t").alias("_len"), *tf)
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_len").cast("double").alias("_total"), *(F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(terms))))
    hit = rows.where("_kept").where(" OR ".join(f"_tf{i} > 0" for i in range(len(terms))))
    joined = hit.crossJoin(F.broadcast(stats))  # one row
    total: Column = F.lit(0.0)
    for i, (_, q) in enumerate(terms):
        n, d, f = F.col("_n"), F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
        length = params.k1 * (1 - params.b + params.b * F.col("_len") / (F.col("_total") / n))
        total = total + (q * (params.k3 + 1) / (q + params.k3)) * idf * (f * (params.k1 + 1) / (f + length))
    return joined.select(id_col, total.alias("score"))


def knn(df: DataFrame, id_col: str, column: str, query: Column | list[float], metric: str = "cosine", keep: Filter | None = None) -> DataFrame:
    """``(id_col, score)`` of every row that has the vector and passes ``keep``, which is applied below the score."""
    kept = df if keep is None else df.where(compile_filter(keep, df.schema))
    vec = F.col(column)
    scored = vectors.score(metric, vec, query) if isinstance(query, Column) else vectors.batch_score(metric, vec, query)
    return kept.where(vec.isNotNull()).select(id_col, scored.alias("score"))


def top(scored: DataFrame, id_col: str, k: int, limit: int = MAX_RESULTS) -> DataFrame:
    """The best ``min(k, limit)`` rows with their ``rank`` from 1; ties go to the lesser id."""
    check_k(k)
    order = [F.col("score").desc(), *ids.ascending(scored, id_col)]
    best = scored.orderBy(*order).limit(min(k, limit))
    # at most 10,000 rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(rankings: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """``(id_col, score)``: the sum over the rankings of ``1 / (k + rank)``."""
    parts = [r.select(id_col, (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(id_col).agg(F.sum("part").alias("score"))
