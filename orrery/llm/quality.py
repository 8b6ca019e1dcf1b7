"""Quality: a convolutional network over bytes, in numpy.

The bytes of the whole text, framed by spaces, are convolved with ``FILTERS`` learned filters of ``WIDTH`` bytes.
Overlapping chunks of ``CHUNK`` bytes, each beginning half a chunk after the one before, keep each filter's greatest
response and their mean response above zero; a dense layer turns those into the chunk's logit.  The document's probability
is the logistic of the mean of its chunks' logits.  Training is stochastic gradient descent with
hand-written gradients on chunks of at most ``MAX_DOCS`` labelled documents, those least by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import column, pieces

FILTERS, WIDTH, CHUNK, MAX_DOCS, THRESHOLD = 12, 5, 512, 3000, 0.5
_HALF = CHUNK // 2


@dataclass(frozen=True)
class Network:
    """``table[j, byte]`` is what a byte at place j adds to each filter's response."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: float

    def responses(self, raw: np.ndarray) -> np.ndarray:
        n = raw.shape[-1] - WIDTH + 1
        total = self.table[0][raw[..., :n]] + self.bias
        for j in range(1, WIDTH):
            total += self.table[j][raw[..., j : j + n]]
        return total

    def probability(self, text: str) -> float:
        raw = np.frombuffer(b" " * (WIDTH // 2) + text.encode() + b" " * (WIDTH // 2), np.uint8)
        if len(raw) < WIDTH:
            raw = np.full(WIDTH, 32, np.uint8)
        n = len(raw) - WIDTH + 1
        # halves of chunks, in slabs that bound the memory; a chunk is two neighbouring halves
        most, above, sizes = [], [], []
        slab = _HALF * 256
        for i in range(0, n, slab):
            r = np.maximum(self.responses(raw[i : min(i + slab, n) + WIDTH - 1]), 0)
            at = np.arange(0, len(r), _HALF)
            most.append(np.maximum.reduceat(r, at))
            above.append(np.add.reduceat(r, at))
            sizes.append(np.diff(np.r_[at, len(r)]))
        most, above, sizes = np.concatenate(most), np.concatenate(above), np.concatenate(sizes)
        if len(most) > 1:
            most, above, sizes = np.maximum(most[1:], most[:-1]), above[1:] + above[:-1], sizes[1:] + sizes[:-1]
        logits = np.concatenate([most, above / sizes[:, None]], 1) @ self.dense + self.out
        return float(1 / (1 + np.exp(-np.clip(logits.mean(), -30, 30))))


def fit(texts: list[str], good: list[int], seed: int = 0, epochs: int = 12) -> Network:
    """Train on whole documents' chunks, of which each epoch draws one a document.  Without both classes everything is of good quality."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
    bias, dense, out = np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), np.float32(0)
    if len(set(good)) < 2:
        return Network(table, bias, np.zeros(2 * FILTERS, np.float32), 30.0)
    raws = [np.frombuffer((t.encode() or b" "), np.uint8) for t in texts]
    y = np.array(good, np.float32)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    params = [table, bias, dense]
    m, v, m0, v0, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0, 0.0, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(raws)), max(1, len(raws) // 32)):
            x = np.full((len(rows), CHUNK + WIDTH - 1), 32, np.uint8)
            live = np.zeros(len(rows), int)
            for k, i in enumerate(rows):
                start = int(rng.integers(0, max(1, len(raws[i]) - CHUNK + 1)))
                part = raws[i][start : start + CHUNK]
                x[k, WIDTH // 2 : WIDTH // 2 + len(part)] = part
                live[k] = max(len(part), 1)
            net = Network(params[0], params[1], params[2], 0.0)
            r = net.responses(x)
            valid = (np.arange(CHUNK)[None] < live[:, None])[..., None]
            r = np.where(valid, np.maximum(r, 0), 0)
            top = r.argmax(1)  # rows, filters
            most, mean = np.take_along_axis(r, top[:, None], 1)[:, 0], r.sum(1) / live[:, None]
            features = np.concatenate([most, mean], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ params[2] + out, -30, 30)))
            g = (p - y[rows]) * weight[rows] / len(rows)
            gf = g[:, None] * params[2]
            gr = np.where(r > 0, (gf[:, FILTERS:] / live[:, None])[:, None], 0).astype(np.float32)
            k, f = np.indices(top.shape)
            gr[k, top, f] += np.where(most > 0, gf[:, :FILTERS], 0)
            gt = np.zeros_like(params[0])
            flat = gr.reshape(-1, FILTERS)
            for j in range(WIDTH):
                codes = x[:, j : j + CHUNK].ravel()
                for c in range(FILTERS):
                    gt[j, :, c] = np.bincount(codes, flat[:, c], 256)
            t += 1
            for i, grad in enumerate((gt, flat.sum(0), features.T @ g)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] = (params[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            m0, v0 = 0.9 * m0 + 0.1 * g.sum(), 0.999 * v0 + 0.001 * g.sum() ** 2
            out = np.float32(out - 0.01 * (m0 / (1 - 0.9**t)) / (np.sqrt(v0 / (1 - 0.999**t)) + 1e-8))
    return Network(*params, float(out))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Network:
    """Train on at most ``max_docs`` documents that have a label; null ids, labels and texts are left out, and
    of several labels of one document the least counts."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_docs)
    # at most max_docs ids
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id").orderBy("doc_id", "text").collect()
    return fit([r.text for r in rows], [int(r.quality > 0) for r in rows])


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            p = [None if t is None else round(net.probability(t), 6) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(p, pa.float64())], names=["doc_id", "p_quality"])

    return run


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_quality, keep)`` for every row, repeated rows and null ids included.

    A null text has a null probability and isn't kept; an empty one is scored as white space.  Whatever
    other columns there are is not read.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("p_quality", T.DoubleType())])
    found = docs.select("doc_id", "text").mapInArrow(_score(net), schema)
    return found.select("doc_id", "p_quality", F.coalesce(F.col("p_quality") >= threshold, F.lit(False)).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
