"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``total * weight / documents of the source`` copies.  Within a source,
in the order of ``doc_id``, the expected copies are summed; the source's one random offset is added; and the
document is emitted once for every integer boundary that its part of the sum crosses.  The sum of
equal parts is rank times part, so what has to be known is the rank: rows are range-partitioned by
(source, doc_id), each partition counts its rows by source, and the small table of those counts
gives the rank at which a partition starts.  No source, however hot, comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, fresh, quoted

SEED = "mix-1"


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) for the source, from 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), source)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: str = SEED, columns: tuple[str, ...] = ("doc_id", "source"), copy_col: str = "copy_no") -> DataFrame:
    """``columns`` and ``copy_col`` (1, 2, ...), one row for each copy.

    ``weights`` are relative target shares by source, finite and not negative; a source without one, or of weight zero, is left out, and so is
    everything where no source has any weight.  By default a source's
    weight is the square root of its number of documents.  ``total`` is the expected number of rows in all,
    by default that of the documents.  A null source is a source of its own, named ''.  Repeated rows count each.  Ties in
    ``doc_id`` (nulls first) are ordered by the text's digest where a text is among ``columns``; rows equal
    in all of that are interchangeable.  No rows give no rows.  Columns not asked for are not read, and none has a name that matters but
    ``copy_col``, which ``columns`` may not hold.
    """
    spark = docs.sparkSession
    if copy_col.lower() in {c.lower() for c in columns}:
        raise ValueError(f"{copy_col} is a column already")
    if weights is not None and not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError("a weight is finite and not negative")
    of, tie, part, at, n, start, before_, each_, offset_, weight, docs_ = fresh([*docs.columns, copy_col], "_source", "_tie", "_part", "_at", "_n", "_start", "_before", "_each", "_offset", "_weight", "_docs")
    plain = docs.select(*map(quoted, columns), F.coalesce(F.col("source"), F.lit("")).alias(of), *([F.xxhash64("text").alias(tie)] if "text" in columns else []), *([] if "doc_id" in columns else [F.col("doc_id")]))
    order = [of, "doc_id", *([tie] if "text" in columns else [])]
    if weights is not None:
        known = spark.createDataFrame([(s or "", float(w)) for s, w in weights.items()], f"{of} string, {weight} double").groupBy(of).agg(F.sum(weight).alias(weight))
        plain = plain.join(F.broadcast(known.select(of)), of, "left_semi")  # the given weights
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at)))
    parts = placed.groupBy(of, part).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(start))
    before = Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn(before_, F.coalesce(F.sum(n).over(before), F.lit(0)))
    sources = parts.groupBy(of).agg(F.sum(n).cast("double").alias(docs_))
    sources = sources.join(known, of) if weights is not None else sources.withColumn(weight, F.sqrt(docs_))
    whole = Window.partitionBy(F.lit(0))  # a row for each source
    goal = F.lit(float(total)) if total is not None else F.sum(docs_).over(whole)
    # weights in millionths, so that their sum is exact in any order
    units = F.floor(F.col(weight) * 1000000.0)
    sums = F.sum(units).over(whole).cast("double")
    share = F.when(sums > 0, goal * units.cast("double") / F.greatest(sums, F.lit(1.0)) / F.col(docs_)).otherwise(0.0)
    each = sources.select(of, share.alias(each_), offset(F.col(of), seed).alias(offset_))
    small = starts.join(each, of).select(of, part, start, before_, each_, offset_)
    rank = F.col(before_) + F.col(at) - F.col(start) + 1
    crossed = F.floor(rank * F.col(each_) + F.col(offset_)) - F.floor((rank - 1) * F.col(each_) + F.col(offset_))
    # one row for a source and a partition: its size follows the number of partitions, and Spark checks it
    joined = placed.join(small, [of, part]).withColumn(n, crossed.cast("int")).where(F.col(n) > 0)
    return joined.select(*map(quoted, columns), F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, every column of them, each as often as the mixture has it."""
    (name,) = fresh(docs.columns, "copy_no")
    return mix(docs, columns=tuple(docs.columns), copy_col=name).drop(name)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s FROM documents),
n AS (SELECT s, count(*)::DOUBLE AS docs FROM d GROUP BY s),
w AS (SELECT s, docs, floor(sqrt(docs) * 1000000.0::DOUBLE) AS weight FROM n),
t AS (SELECT sum(docs) AS total, sum(weight) AS weights FROM w),
e AS (SELECT s, total * weight / weights / docs AS part,
  ('0x' || substr(md5('mix-1|' || s), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM w, t),
r AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.s ORDER BY d.doc_id NULLS FIRST) AS rk, part, u FROM d JOIN e USING (s)),
c AS (SELECT doc_id, source, (floor(rk * part + u) - floor((rk - 1) * part + u))::INT AS copies FROM r)
SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy_no FROM c WHERE copies > 0
"""
