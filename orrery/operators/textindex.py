"""A stored text index: blocks of postings by term, searched with the scores of BM25.

The table is partitioned by a hash of the term.  Each row is a block: up to ``BLOCK`` documents with a term, their frequencies and lengths, and
the greatest frequency and least length among them, which bound the score of every document in the block for any parameters.  A search reads
the partitions of its terms only.  For a top k without a filter it first scores the blocks of the highest bounds; whatever block can't
reach the kth score found there, with all the other terms at their best, is not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import text

#: Tokens that are counted at once, whatever a batch holds of them.
BLOCK, BUCKETS, SLICE = 256, 32, 1 << 17


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ids and token lists a row for each document and term; ``first`` marks one row of each document."""
    for batch in batches:
        every = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # whole documents, cut where another SLICE of tokens begins
        cuts = np.flatnonzero(np.diff((np.cumsum(every) - every) // SLICE)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(every)]):
            part, sizes = batch.slice(start, stop - start), every[start:stop]
            coded = part.column(1).flatten().dictionary_encode()
            n = max(len(coded.dictionary), 1)
            found, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = found // n
            cols = [part.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(found % n)), pa.array(tf.astype(np.int32)), pa.array(sizes[row].astype(np.int32)), pa.array(np.diff(row, prepend=-1) != 0)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "term", "tf", "len", "first"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, term and id the blocks; the last, unfinished one waits for the next batch."""

    def emit(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        stops = pa.array(np.r_[starts, rows.num_rows].astype(np.int32))
        column = lambda c: rows.column(c).combine_chunks()
        tf, length, first = (column(c).to_numpy(zero_copy_only=False) for c in ("tf", "len", "first"))
        lists = [pa.ListArray.from_arrays(stops, column(c)) for c in ("id", "tf", "len")]
        heads = [column(c).take(pa.array(starts)) for c in ("bucket", "term")]
        sums = [pa.array(np.diff(np.r_[starts, rows.num_rows]).astype(np.int32)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), pa.array(np.add.reduceat(first.astype(np.int64), starts)), pa.array(np.add.reduceat(tf.astype(np.int64), starts))]
        return pa.RecordBatch.from_arrays([*heads, *sums, *lists], names=["bucket", "term", "n", "max_tf", "min_len", "firsts", "tokens", "ids", "tfs", "lens"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = np.r_[0, np.flatnonzero(np.diff(term)) + 1]
        sizes = np.diff(np.r_[runs, len(term)])
        each = -(-sizes // BLOCK)
        starts = np.repeat(runs, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * BLOCK
        if len(starts) > 1:
            yield emit(rows.slice(0, int(starts[-1])), starts[:-1])
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield emit(held, np.array([0]))


@dataclass
class TextIndex:
    """Where the blocks lie, and how many documents and tokens they stand for; ``notes`` has the blocks that the last search read and skipped."""

    spark: SparkSession
    path: str
    doc_count: int
    total_len: int
    id_type: str = "bigint"
    notes: dict = field(default_factory=dict)

    @staticmethod
    def build(df: DataFrame, id_col: str, column: str, path: str) -> TextIndex:
        """One pass over the text and one shuffle of (document, term) rows, in which a hot term is dealt to several tasks."""
        spark = df.sparkSession
        rows = text.token_rows(df, id_col, column).where(F.size("_t") > 0).toDF("id", "_t")
        kind = T.StructType([rows.schema["id"], *T.StructType.fromDDL("term string, tf int, len int, first boolean")])
        counted = rows.mapInArrow(_count, kind).withColumn("bucket", _bucket(F.col("term")))
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        dealt = counted.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "term", "id").select("bucket", "term", "id", "tf", "len", "first")
        own = TextIndex(spark, path, 0, 0, rows.schema["id"].dataType.simpleString())
        dealt.mapInArrow(_blocks, own.schema).write.mode("overwrite").partitionBy("bucket").parquet(path)
        own.doc_count, own.total_len = own.blocks.agg(F.coalesce(F.sum("firsts"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        return own

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(f"bucket int, term string, n int, max_tf int, min_len int, firsts long, tokens long, ids array<{self.id_type}>, tfs array<int>, lens array<int>")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def terms(self, query: str) -> dict[str, tuple[int, int]]:
        """The query's terms with their counts and buckets."""
        found = self.spark.sql("SELECT 1").select(F.transform(text.tokens(F.lit(query)), lambda t: F.struct(t, _bucket(t)))).first()[0]
        counts = Counter(t for t, _ in found)
        return {t: (counts[t], b) for t, b in found}

    def search(self, query: str, k1: float, b: float, k3: float, k: int | None = None, least: int = 64) -> DataFrame:
        """``(id, score)`` of the documents with a term of ``query``; with ``k``, of all that can be among the best ``k`` at least.

        Blocks are skipped only where the query's terms have more than ``least``.
        """
        terms = self.terms(query)
        blocks = self.blocks
        none = blocks.select(F.explode("ids").alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
        self.notes = {"read": 0, "skipped": 0, "scored": 0}
        if not terms or not self.doc_count:
            return none
        part = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / (self.total_len / self.doc_count)))
        rows = blocks.where(F.col("bucket").isin(sorted({x for _, x in terms.values()})) & F.col("term").isin(sorted(terms)))
        bound = part(F.col("max_tf"), F.col("min_len"))
        stats = {r.term: r for r in rows.groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("best"), F.count(F.lit(1)).alias("blocks")).collect()}  # a row for each term
        weights = {t: q * (k3 + 1) / (q + k3) * math.log(1 + (self.doc_count - stats[t].df + 0.5) / (stats[t].df + 0.5)) for t, (q, _) in terms.items() if t in stats}
        if not weights:
            return none
        of = F.element_at(F.create_map(*(F.lit(x) for t, w in weights.items() for x in (t, w))), F.col("term"))

        place = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(weights) for x in (t, i))), F.col("term"))

        def scored(some: DataFrame) -> DataFrame:
            each = some.select("term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))))
            # a sum's last bits depend on its order: that of the query, for copies of a document to tie and the scan to give the same
            parts = F.array_sort(F.collect_list(F.struct(place.alias("at"), (of * part(F.col("tf"), F.col("len"))).alias("x"))))
            return each.groupBy("id").agg(parts.alias("_p")).select("id", F.aggregate("_p", F.lit(0.0), lambda total, p: total + p["x"]).alias("score"))

        total = sum(r.blocks for r in stats.values())
        self.notes = {"read": total, "skipped": 0, "scored": sum(r.df for r in stats.values())}
        if k is not None and total > least:
            best = {t: w * stats[t].best for t, w in weights.items()}
            seeds = rows.withColumn("_b", of * bound).orderBy(F.col("_b").desc()).limit(-(-k // BLOCK) + len(weights)).drop("_b")  # some blocks of the highest bounds
            kth = scored(seeds).orderBy(F.col("score").desc()).limit(k).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
            if kth.n == k:
                others = F.element_at(F.create_map(*(F.lit(x) for t in weights for x in (t, sum(best.values()) - best[t]))), F.col("term"))
                rows = rows.where(of * bound + others >= kth.s - 1e-9)
                read = rows.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
                self.notes = {"read": read.blocks, "skipped": total - read.blocks, "scored": read.n}
        return scored(rows)

    def term_stats(self, column: str = "term") -> DataFrame:
        """``(term, df, blocks, max_tf)`` of every term."""
        return self.blocks.groupBy(F.col("term").alias(column)).agg(F.sum("n").cast("long").alias("df"), F.count(F.lit(1)).alias("blocks"), F.max("max_tf").cast("long").alias("max_tf"))
