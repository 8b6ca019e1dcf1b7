"""Inverted-file index over a vector column: a stored table by cluster, probes, one-bit estimates, recall, maintenance.

The table is partitioned by ``cluster_id``; beside the vector stand its one-bit code, the residual's length and the product of the code with its
direction.  A search reads the partitions of the probed clusters only.  The index may hold several versions of a row, of which the
newest counts, and rows written since it was published are given to the search, which scores them exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.functions import vectors
from orrery.operators.filters import Filter, compile_filter

MAX_CLUSTERS, ROUNDS, PROBES, EPSILON, NEIGHBOURHOOD = 16, 8, 4, 1.9, 64


def nearest(vec: Column, centroids: list[list[float]], metric: str) -> Column:
    """Index of the best centroid, the lowest of equals, a batch of rows at a time."""
    c = np.array(centroids, float)

    @F.arrow_udf("int")
    def run(v: pa.Array) -> pa.Array:
        x = vectors.matrix(v, c.shape[1])
        # a hair's breadth apart counts as equal, whatever order a product was summed in
        s = np.round(np.nan_to_num(vectors.scores(x, c, metric), nan=-np.inf), 12)
        return pa.array(s.argmax(1).astype(np.int32) if len(s) else np.empty(0, np.int32))

    return run(vec)


def assign(df: DataFrame, vec_col: str, centroids: list[list[float]], metric: str) -> DataFrame:
    return df.withColumn("cluster_id", nearest(F.col(vec_col), centroids, metric))


def _sums(dim: int):
    """Of a task's rows the sum and number of each cluster's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at, x = batch.column(0).to_numpy(), vectors.matrix(batch.column(1), dim)
            for c in np.unique(at):
                own = x[at == c]
                total[int(c)] = total.get(int(c), np.zeros(dim + 1)) + np.r_[own.sum(0), len(own)]
        rows = [(c, p, v) for c, t in total.items() for p, v in enumerate(t)]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64()))], names=["cluster_id", "pos", "x"])

    return run


def means(assigned: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``(cluster_id, centroid)``, element by element; every task adds up its own rows first."""
    parts = assigned.select("cluster_id", vec_col).mapInArrow(_sums(dim), "cluster_id int, pos int, x double").groupBy("cluster_id", "pos").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("s"))
    return whole.select("cluster_id", F.transform(F.slice("s", 1, dim), lambda x: x / F.element_at("s", -1)).alias("centroid"))


def kmeans(df: DataFrame, id_col: str, vec_col: str, metric: str = "cosine", k: int | None = None, rounds: int = ROUNDS) -> list[list[float]]:
    """Centroids from evenly spaced rows in the order of ids, moved by ``rounds`` of Lloyd's method; an empty cluster stays where it was.

    The vectors are kept by the executors from round to round; the driver holds the centroids.
    """
    rows = df.select(id_col, vec_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if not n:
            return []
        k = k or min(max(math.ceil(math.sqrt(n)), 1), MAX_CLUSTERS)
        wanted = sorted({i * n // k for i in range(k)})
        # the ranks come from the partitions' counts of sorted ids, so no task holds all rows
        ids = rows.select(id_col).repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("p", F.spark_partition_id()).withColumn("r", F.monotonically_increasing_id()).persist()
        counts = ids.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r")).orderBy("p").collect()
        marks, before = [], 0
        for c in counts:
            marks += [c.r + w - before for w in wanted if before <= w < before + c.n]
            before += c.n
        first = rows.join(F.broadcast(ids.where(F.col("r").isin(marks)).select(id_col)), id_col).select(id_col, vec_col).orderBy(id_col).collect()  # k rows
        ids.unpersist()
        centroids = [[float(x) for x in r[vec_col]] for r in first]
        for _ in range(rounds):
            for r in means(assign(rows, vec_col, centroids, metric), vec_col, len(centroids[0])).collect():
                c = np.array(r.centroid)
                length = np.linalg.norm(c)
                centroids[r.cluster_id] = list(map(float, c / length if metric == "cosine" and length > 0 else c))
        return centroids
    finally:
        rows.unpersist()


# ---------------------------------------------------------------- one-bit codes


def _signs(width: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, width) * 2.0 - 1


def _rotate(x: np.ndarray) -> np.ndarray:
    """Padded to a power of two, random signs, Walsh-Hadamard transform, unit scale."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    y *= _signs(width)
    h = 1
    while h < width:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
        h *= 2
    return y.reshape(len(x), width) / math.sqrt(width)


def codes(x: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector's residual the sign bits, its length, and the product of its direction with its code."""
    r = _rotate(x - centroid)
    norm = np.linalg.norm(r, axis=1)
    bits = r > 1e-9  # a residual without length has the same code whatever a sum's last bit is
    code = np.where(bits, 1.0, -1.0) / math.sqrt(r.shape[1])
    return bits, norm, np.where(norm > 0, (r * code).sum(1) / np.where(norm > 0, norm, 1), 1.0)


def estimates(bits: np.ndarray, norm: np.ndarray, product: np.ndarray, query: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances and bounds of their error."""
    q = _rotate((query - centroid)[None])[0]
    width, length = len(q), np.linalg.norm(q)
    inner = (np.where(bits, 1.0, -1.0) / math.sqrt(width)) @ q / product
    error = EPSILON * norm * length * np.sqrt(np.maximum(1 - product**2, 0)) / product / math.sqrt(max(width - 1, 1))
    return norm**2 + length**2 - 2 * norm * inner, 2 * error


def packed_estimates(code: np.ndarray, norm: np.ndarray, product: np.ndarray, query: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Estimated squared distances from codes as packed bytes, the query rounded to 4 bits a dimension: four planes of bits, and counts of the bits in common."""
    q = _rotate((query - centroid)[None])[0]
    width, low = len(q), q.min()
    step = max((q.max() - low) / 15, 1e-30)
    levels = np.rint((q - low) / step).astype(np.uint8)
    common = sum((1 << b) * np.bitwise_count(code & np.packbits(levels >> b & 1)[None]).sum(1, dtype=np.int64) for b in range(4))
    set_ = np.bitwise_count(code).sum(1, dtype=np.int64)
    # the sum over set bits, twice, less the sum over all
    inner = (2 * (low * set_ + step * common) - (low * width + step * levels.sum(dtype=np.int64))) / math.sqrt(width) / product
    return norm**2 + (q**2).sum() - 2 * norm * inner


def encode(df: DataFrame, id_col: str, vec_col: str, centroids: list[list[float]], *keep: str) -> DataFrame:
    """``(id_col, *keep, cluster_id, code, norm, product)`` with the code's bits packed in bytes."""
    schema = T.StructType([*(df.schema[c] for c in (id_col, *keep)), *T.StructType.fromDDL("cluster_id int, code binary, norm double, product double")])
    plain = df.select(id_col, *keep, F.col("cluster_id").alias("_c"), F.col(vec_col).alias("_v"))
    c = np.array(centroids, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 2).to_numpy()
            bits, norm, product = codes(vectors.matrix(batch.column(batch.num_columns - 1), c.shape[1]) - c[at], np.zeros(c.shape[1]))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()), pa.array(norm), pa.array(product)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return plain.mapInArrow(run, schema)


def estimate(coded: DataFrame, id_col: str, vector: list[float], centroids: list[list[float]]) -> DataFrame:
    """``(id_col, estimate, error)`` of squared L2 distances from the codes alone."""
    kind = T.StructType([coded.schema[id_col], T.StructField("estimate", T.DoubleType()), T.StructField("error", T.DoubleType())])
    width = 1 << max(0, (len(vector) - 1).bit_length())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for c, g in p.groupby("cluster_id"):
                bits = np.unpackbits(np.frombuffer(b"".join(g["code"]), np.uint8).reshape(len(g), -1), axis=1)[:, :width].astype(bool)
                e, err = estimates(bits, g["norm"].to_numpy(), g["product"].to_numpy(), np.array(vector, float), np.array(centroids[c]))
                yield pd.DataFrame({id_col: g[id_col], "estimate": e, "error": err})

    return coded.select(id_col, "cluster_id", "code", "norm", "product").mapInPandas(run, kind)


# ---------------------------------------------------------------- the index


@dataclass(frozen=True)
class Index:
    """Centroids of a column, and where the tables of its rows lie, oldest first; ``touched`` has the rows whose versions are dead.

    ``tables`` are ``(path, version)``; of a row in several the newest counts.  ``touched`` are ``(path, version)`` of tables of ids that were written at a version.
    """

    spark: SparkSession
    id_col: str
    vec_col: str
    metric: str
    centroids: list[list[float]]
    tables: tuple[tuple[str, int], ...]
    touched: tuple[tuple[str, int], ...] = ()

    @staticmethod
    def build(df: DataFrame, id_col: str, vec_col: str, path: str, metric: str = "cosine", rounds: int = ROUNDS, version: int = 0) -> Index:
        base = df.where(F.col(vec_col).isNotNull())
        own = Index(df.sparkSession, id_col, vec_col, metric, kmeans(base, id_col, vec_col, metric, rounds=rounds), ())
        return own._write(base, path, version)

    def _write(self, rows: DataFrame, path: str, version: int) -> Index:
        if not self.centroids:
            return self
        other = [c for c in rows.columns if c not in (self.id_col, "cluster_id", "code", "norm", "product")]
        coded = encode(assign(rows, self.vec_col, self.centroids, self.metric), self.id_col, self.vec_col, self.centroids, *other)
        coded.repartition("cluster_id", F.pmod(F.xxhash64(self.id_col), F.lit(8))).write.mode("overwrite").partitionBy("cluster_id").parquet(path)
        return replace(self, tables=(*self.tables, (path, version)))

    def append(self, df: DataFrame, path: str, version: int, touched: str | None = None) -> Index:
        """Rows assigned to the clusters there are, as a newer version; ``touched`` is a table of all ids written at it, deleted ones too, by default those of ``df``."""
        if touched is None:
            touched = path + "-touched"
            df.select(self.id_col).write.mode("overwrite").parquet(touched)
        return replace(self._write(df.where(F.col(self.vec_col).isNotNull()), path, version), touched=(*self.touched, (touched, version)))

    def rows(self, clusters: list[int] | None = None) -> DataFrame:
        """The living rows, of some clusters only: from each table those that no later version touched."""
        parts = []
        for path, version in self.tables:
            part = self.spark.read.parquet(path)
            part = part if clusters is None else part.where(F.col("cluster_id").isin(clusters) if clusters else F.lit(False))
            for ids, later in self.touched:
                if later > version:
                    part = part.join(self.spark.read.parquet(ids).select(self.id_col), self.id_col, "left_anti")
            parts.append(part.withColumn("version", F.lit(version)))
        if not parts:
            return self.spark.createDataFrame([], f"{self.id_col} bigint, {self.vec_col} array<float>, code binary, norm double, product double, cluster_id int, version int")
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        return whole

    @property
    def table(self) -> DataFrame:
        return self.rows()

    def probe(self, vector: list[float], metric: str, probes: int | None, allowed: list[int] | None = None) -> list[int]:
        """The best clusters, those without a row that passes the filter left out first."""
        if not self.centroids:
            return []
        s = np.round(vectors.scores(np.array([vector], float), np.array(self.centroids), metric)[0], 12)
        order = [i for i in sorted(range(len(s)), key=lambda i: (-s[i], i)) if allowed is None or i in allowed]
        return order[: min(max(PROBES if probes is None else probes, 1), len(s))]

    def _allowed(self, keep: Filter | None) -> list[int] | None:
        if keep is None:
            return None
        rows = self.rows()
        return [r.cluster_id for r in rows.where(compile_filter(keep, rows.schema)).select("cluster_id").distinct().collect()]  # 16 at most

    def search(self, vector: list[float], metric: str | None = None, probes: int | None = None, keep: Filter | None = None, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
        """``(id, score)`` of the living rows in the probed clusters.

        ``fresh`` are rows written since the index was published, which are scored exactly, and ``gone`` the ids of all that were written or
        deleted since; the index's own rows of those ids don't count.
        """
        metric = metric or self.metric
        vectors.check(vector, len(self.centroids[0]) if self.centroids else None, metric)
        rows = self.rows(self.probe(vector, metric, probes, self._allowed(keep)))
        if keep is not None:
            rows = rows.where(compile_filter(keep, rows.schema))
        score = vectors.batch_score(metric, F.col(self.vec_col), vector).alias("score")
        hits = rows.select(self.id_col, self.vec_col)
        if gone is not None:
            hits = hits.join(gone.select(self.id_col), self.id_col, "left_anti")
        hits = hits.select(self.id_col, score)
        if fresh is None:
            return hits
        later = fresh if keep is None else fresh.where(compile_filter(keep, fresh.schema))
        return hits.unionByName(later.where(F.col(self.vec_col).isNotNull()).select(self.id_col, score))

    def search_l2(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """Top rows by L2 from the stored codes: estimates first; exact scores where an estimate's lower bound is within the kth best upper bound."""
        rows = self.rows(self.probe(vector, "l2", probes))
        estimated = estimate(rows, self.id_col, vector, self.centroids)
        bound = estimated.select((F.col("estimate") + F.col("error")).alias("u")).orderBy("u").limit(k).agg(F.max("u").alias("bound"), F.count(F.lit(1)).alias("n"))
        near = estimated.crossJoin(F.broadcast(bound)).where((F.col("estimate") - F.col("error") <= F.col("bound")) | (F.col("n") < k)).select(self.id_col)  # one row
        return rows.select(self.id_col, self.vec_col).join(near, self.id_col).select(self.id_col, vectors.batch_score("l2", F.col(self.vec_col), vector).alias("score"))

    def stats(self) -> DataFrame:
        """``(cluster_id, n)`` of the living rows."""
        return self.rows().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def versions(self) -> DataFrame:
        """``(cluster_id, live, stale, appended)``: rows that count, rows that a later version has replaced, and living rows that came after the build."""
        whole = [self.spark.read.parquet(p).select("cluster_id").withColumn("stored", F.lit(1)) for p, _ in self.tables]
        stored = whole[0]
        for p in whole[1:]:
            stored = stored.union(p)
        first = self.tables[0][1]
        live = self.rows().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("version") > first).alias("appended"))
        both = stored.groupBy("cluster_id").agg(F.sum("stored").alias("stored")).join(live, "cluster_id", "left").na.fill(0)
        return both.select("cluster_id", "live", (F.col("stored") - F.col("live")).alias("stale"), "appended")

    def plan(self) -> DataFrame:
        """``(cluster_id, n, action)``: split above twice the even share, merge below half of it."""
        target = F.ceil(F.sum("n").over(Window.partitionBy(F.lit(0))) / F.lit(max(1, len(self.centroids))))  # 16 rows
        return self.stats().withColumn("action", F.when(F.col("n") > 2 * target, "split").when(2 * F.col("n") < target, "merge").otherwise("keep"))

    def neighbours(self, cluster: int, n: int = NEIGHBOURHOOD) -> list[int]:
        """The cluster and the ``n`` whose centroids are nearest to its own."""
        s = vectors.scores(np.array([self.centroids[cluster]]), np.array(self.centroids), self.metric)[0]
        return sorted(sorted(range(len(s)), key=lambda i: (i != cluster, -s[i], i))[: n + 1])

    def reassign(self, clusters: list[int] | None = None) -> DataFrame:
        """``(id, cluster_id, nearest)`` of the living rows, of some clusters only, that lie nearer to another centroid."""
        return self.rows(clusters).select(self.id_col, "cluster_id", nearest(F.col(self.vec_col), self.centroids, self.metric).alias("nearest")).where("cluster_id <> nearest")

    def moved(self, path: str, version: int, clusters: list[int] | None = None) -> Index:
        """The rows that ``reassign`` names, written again where they belong."""
        ids = self.reassign(clusters).select(self.id_col)
        rows = self.rows().join(ids, self.id_col, "left_semi").drop("cluster_id", "code", "norm", "product", "version")
        return self.append(rows, path, version)

    def rebuild(self, clusters: list[int], k: int, path: str, version: int = 0) -> Index:
        """A new table: the rows of ``clusters`` in ``k`` new ones, which come after the others."""
        local = self.rows(clusters)
        own = kmeans(local, self.id_col, self.vec_col, self.metric, k)
        rest = [i for i in range(len(self.centroids)) if i not in clusters]
        new = replace(self, centroids=[self.centroids[i] for i in rest] + own, tables=(), touched=())
        places = F.element_at(F.create_map(*(F.lit(v) for i, o in enumerate(rest) for v in (o, i))), F.col("cluster_id")) if rest else F.lit(0)
        others = self.rows(rest).withColumn("cluster_id", places.cast("int"))
        if own:
            others = others.unionByName(assign(local, self.vec_col, own, self.metric).withColumn("cluster_id", F.col("cluster_id") + len(rest)))
        keep = [c for c in others.columns if c not in (self.id_col, "cluster_id", "code", "norm", "product", "version")]
        encode(others, self.id_col, self.vec_col, new.centroids, *keep).write.mode("overwrite").partitionBy("cluster_id").parquet(path)
        return replace(new, tables=((path, version),))


# ---------------------------------------------------------------- recall

_U64 = (1 << 64) - 1


def sample_key(id_: int) -> int:
    """FNV-1a of the id's big-endian bytes, mixed."""
    h = 0xCBF29CE484222325
    for b in int(id_).to_bytes(8, "big", signed=True):
        h = ((h ^ b) * 0x100000001B3) & _U64
    h = (h + 0x9E3779B97F4A7C15) & _U64
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _U64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _U64
    return h ^ (h >> 31)


@F.pandas_udf(T.StringType())
def sample_key_hex(ids: pd.Series) -> pd.Series:
    return ids.map(lambda i: f"{sample_key(i):016x}")


def sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows whose key is least: the same ones each time."""
    return df.withColumn("_key", sample_key_hex(F.col(id_col).cast("long"))).orderBy("_key", id_col).limit(n).drop("_key")


def recall_at(exact: list, ann: list, k: int) -> float:
    """How much of the exact result the approximate one has."""
    return len(set(exact[:k]) & set(ann[:k])) / max(1, min(k, len(exact)))


def recall(index: Index, num: int = 25, k: int = 10, probes: int | None = None, metric: str | None = None, keep: Filter | None = None, fresh: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """``(sample_id, n_exact, n_ann, recall)`` for sampled rows as queries, all in one plan; a row is among its own results.

    ``fresh`` and ``gone`` are as for a search: what was written since is found by either.
    """
    metric = metric or index.metric
    rows = index.rows()
    if gone is not None:
        rows = rows.join(gone.select(index.id_col), index.id_col, "left_anti")
    if fresh is not None:
        rows = rows.unionByName(fresh.where(F.col(index.vec_col).isNotNull()).withColumn("cluster_id", F.lit(-1)), allowMissingColumns=True)
    rows = rows if keep is None else rows.where(compile_filter(keep, rows.schema))
    chosen = sample(rows, index.id_col, num).select(F.col(index.id_col).alias("sample_id"), F.col(index.vec_col).alias("q")).orderBy("sample_id").collect()
    allowed = index._allowed(keep)
    # at most num samples, each with its probed clusters
    ids = [r.sample_id for r in chosen]
    q = np.array([list(r.q) for r in chosen], float).reshape(len(ids), -1)
    probed = [{-1, *index.probe(list(x), metric, probes, allowed)} for x in q]
    kind = T.StructType([T.StructField("sample_id", rows.schema[index.id_col].dataType), T.StructField("id", rows.schema[index.id_col].dataType), *T.StructType.fromDDL("s double, near boolean")])
    id_type = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(rows.schema[index.id_col].dataType, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.round(vectors.scores(vectors.matrix(batch.column(2), q.shape[1]), q, metric), 12)
            clusters, own = batch.column(1).to_numpy(), np.array(batch.column(0).to_pylist())
            for j in range(len(ids)):
                near = np.isin(clusters, list(probed[j]))
                order = np.lexsort((own, -s[:, j]))
                at = np.union1d(order[:k], order[near[order]][:k])  # a batch's best of either kind are all of it that can count
                yield pa.RecordBatch.from_arrays([pa.array([ids[j]] * len(at), id_type), batch.column(0).take(pa.array(at)), pa.array(s[at, j]), pa.array(near[at])], names=["sample_id", "id", "s", "near"])

    scored = rows.select(index.id_col, "cluster_id", index.vec_col).mapInArrow(run, kind)
    by = Window.partitionBy("sample_id").orderBy(F.col("s").desc(), "id")
    exact = scored.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("sample_id").agg(F.collect_list("id").alias("exact"))
    ann = scored.where("near").withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("sample_id").agg(F.collect_list("id").alias("ann"))
    both = exact.join(ann, "sample_id", "left").withColumn("ann", F.coalesce("ann", F.array().cast(T.ArrayType(rows.schema[index.id_col].dataType))))
    return both.select("sample_id", F.size("exact").alias("n_exact"), F.size("ann").alias("n_ann"), (F.size(F.array_intersect("exact", "ann")) / F.greatest(F.lit(1), F.least(F.lit(k), F.size("exact")))).alias("recall"))


def averages(recalls: DataFrame) -> DataFrame:
    """One row: the mean recall and the mean sizes of both results."""
    return recalls.agg(F.avg("recall").alias("recall"), F.avg("n_exact").alias("n_exact"), F.avg("n_ann").alias("n_ann"), F.count(F.lit(1)).alias("samples"))
