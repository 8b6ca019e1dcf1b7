"""Exact top-k search with a vector-approximation file: rows whose id is divisible by ``EVERY`` are the queries, against all rows.

The file holds, for each vector, one byte a dimension (the cell between the dimension's least and greatest
value in the table) and the vector's distance from the middle of its cells.  By the triangle
inequality a query's distance from the middle, less or plus that, bounds its distance from the vector.

Queries are taken in groups of a fixed size, which every task has whole.  One scan of the file gives each query the kth least upper
bound; a second leaves the vectors whose lower bound isn't above it.  Of those the exact vectors are read in
the order of their lower bounds, in two rounds: the first k, and then only those whose lower bound isn't above the kth exact distance so far,
beyond which no vector can be nearer.  Only ids and bounds are shuffled, never the file; vectors that no bound lets through are not joined.
The work is that of the stated queries times all rows, spread over the file's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import column, cut

#: Neighbours; of which ids the rows are queries; queries that a scan has at once, and that it multiplies at once; vectors in a block of the file.
K, EVERY, GROUP, TILE, BLOCK = 10, 100, 8192, 1024, 1024


def _extent(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            x = np.array(column(batch, "vec"), np.float64).reshape(-1, dim)
            if len(x):
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    return run


def approximate(x: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each vector and its distance from their middle, rounded up."""
    cells = np.clip((x - low) / step, 0, 255).astype(np.uint8)
    middle = (low + (cells + 0.5) * step).astype(np.float32).astype(np.float64)
    return cells, np.nextafter(np.sqrt(((x - middle) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))


def _file(dim: int, low: np.ndarray, step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = np.array(column(part, "id"), np.int64)
                cells, rest = approximate(np.array(column(part, "vec"), np.float64).reshape(-1, dim), low, step)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, cells, rest)], names=["ids", "cells", "rest"])

    return run


def rounding(dim: int) -> np.float32:
    """Bound of the single-precision error of a squared distance over ``dim`` dimensions, as a share of both squared lengths."""
    return np.float32((2 * dim + 16) * 2.0**-24)


class Queries:
    """A group's ids and vectors, and the bounds of their distances from a block of the file."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.ids, self.x, self.low, self.step = ids, x, low, step
        self.squares = (x.astype(np.float64) ** 2).sum(1).astype(np.float32)

    def bounds(self, row: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """By tiles of queries: which, the block's ids, and lower and upper bounds; a query's own row is infinitely far."""
        other, dim = np.frombuffer(row["ids"], np.int64), self.x.shape[1]
        middle = (self.low + (np.frombuffer(row["cells"], np.uint8).reshape(-1, dim) + 0.5) * self.step).astype(np.float32)
        rest, far = np.frombuffer(row["rest"], np.float32), np.float32(np.inf)
        lengths = (middle * middle).sum(1)[None]
        for i in range(0, len(self.ids), TILE):
            tile = slice(i, i + TILE)
            scale = self.squares[tile, None] + lengths
            d = scale - 2 * (self.x[tile] @ middle.T)
            slack = scale * rounding(dim)
            lower = np.nextafter(np.sqrt(np.maximum(d - slack, 0)) - rest, -far)
            upper = np.nextafter(np.sqrt(np.maximum(d + slack, 0)) + rest, far)
            own = self.ids[tile, None] == other[None]
            lower[own] = upper[own] = far
            yield tile, other, lower, upper


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _upper(queries: Queries, k: int):
    """A task's k least upper bounds of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries.ids), k), np.inf, np.float32)
        for row in _rows(batches):
            for tile, _, _, upper in queries.bounds(row):
                best[tile] = np.partition(np.concatenate([best[tile], upper], 1), k - 1, 1)[:, :k]
        q, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(best[np.isfinite(best)].astype(np.float64))], names=["q", "upper"])

    return run


def _candidates(queries: Queries, bound: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for tile, other, lower, upper in queries.bounds(row):
                q, o = np.nonzero((lower <= bound[tile, None]) & np.isfinite(upper))
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[tile][q]), pa.array(other[o]), pa.array(lower[q, o].astype(np.float64))], names=["q", "id", "lower"])

    return run


def _distances(queries: Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(queries.ids)
        for batch in batches:
            q, id_ = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("q", "id"))
            x = np.array(column(batch, "vec"), np.float64).reshape(len(q), -1)
            own = queries.x[order[np.searchsorted(queries.ids[order], q)]].astype(np.float64)
            d = np.sqrt(((x - own) ** 2).sum(1)) if len(q) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(id_), pa.array(d)], names=["q", "id", "distance"])

    return run


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, group: int = GROUP) -> DataFrame:
    """``(vec_id, rank, neighbor_id, distance)``: for every vector whose id is divisible by ``every`` its ``k`` nearest others by Euclidean distance.

    Ties go to the lesser id.  Rows whose id or vector is null, or whose vector is empty or holds a null, NaN or infinity, take no
    part.  Of rows with one id the least vector counts, so repeated rows are one.  Vectors of each length are searched among themselves, one length after
    another; fewer than ``k + 1`` of a length give as many neighbours as there are.  An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("neighbor_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sound = plain.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    base = cut(sound.groupBy("id").agg(F.min("vec").alias("vec")))
    asks = F.col("id") % every == 0
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked")).where("dim > 0 AND n > 1 AND asked > 0").orderBy("dim").collect()  # a row for each length
    found = [g for r in sizes for g in _of_length(base.where(F.size("vec") == r.dim), r.dim, -(-r.asked // group), asks, k)]
    return reduce(DataFrame.union, found).select(F.col("q").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), "distance") if found else spark.createDataFrame([], kind)


def _of_length(base: DataFrame, dim: int, groups: int, asks, k: int) -> list[DataFrame]:
    extent = base.mapInArrow(_extent(dim), "d int, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    low, high = np.array([r.low for r in extent]), np.array([r.high for r in extent])
    step = np.maximum((high - low) / 256, 1e-12)
    # of equal vectors no query has more than the k + 1 of least ids among its neighbours and itself, so a vector that many rows share is scanned that often
    alike = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    pool = base.withColumn("alike", alike).where(F.col("alike") <= k + 1).select("id", "vec")
    file = cut(pool.mapInArrow(_file(dim, low, step), "ids binary, cells binary, rest binary"))
    return [_of_group(base, file, base.where(asks & (F.pmod(F.xxhash64("id"), F.lit(groups)) == g)), low, step, k) for g in range(groups)]


def _of_group(base: DataFrame, file: DataFrame, asked: DataFrame, low: np.ndarray, step: np.ndarray, k: int) -> DataFrame:
    table = asked.orderBy("id").toArrow()  # one group of queries
    ids = table.column("id").to_numpy()
    queries = Queries(ids, np.array(table.column("vec").to_pylist(), np.float32).reshape(len(ids), len(low)), low, step)
    # a task has k bounds for a query at most; of all of them the kth least counts
    uppers = file.mapInArrow(_upper(queries, k), "q long, upper double").groupBy("q").agg(F.sort_array(F.collect_list("upper")).alias("u"))
    bound = np.full(len(ids), np.inf, np.float32)
    for r in uppers.where(F.size("u") >= k).select("q", F.element_at("u", k).alias("u")).collect():  # a row for each query of the group
        bound[np.searchsorted(ids, r.q)] = r.u
    candidates = file.mapInArrow(_candidates(queries, bound), "q long, id long, lower double")
    turn = F.row_number().over(Window.partitionBy("q").orderBy("lower", "id"))
    candidates = cut(candidates.withColumn("turn", turn))

    def read(some: DataFrame) -> DataFrame:
        return some.join(base, "id").select("q", "id", "vec").mapInArrow(_distances(queries), "q long, id long, distance double")

    first = cut(read(candidates.where(F.col("turn") <= k)))
    kth = first.groupBy("q").agg(F.max("distance").alias("kth"))
    near = first.union(read(candidates.where(F.col("turn") > k).join(kth, "q").where("lower <= kth").select("q", "id")))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("rank") <= k)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("distance", F.round("distance", 6))


OP5_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rk FROM p)
SELECT vec_id, rk::INT AS rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rk <= 10
"""
