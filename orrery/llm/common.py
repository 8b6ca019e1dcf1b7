"""Helpers the corpus operators share: shared folder, token tables, word hashes, grouping."""

from __future__ import annotations

import base64
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into pre-tokens before any merge; the public pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which ``spark.checkpoint.dir`` names.

    Where the session names none, one machine's own temporary folder serves if that machine is all there is; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    given = spark.conf.get("spark.checkpoint.dir", None) or (None if current.isEmpty() else current.get())
    if given is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="orrery-checkpoint-")
    if current.isEmpty():
        sc.setCheckpointDir(given)
    return given


def work_path(spark: SparkSession) -> str:
    """A new path in a folder of this application's own under the shared one, which goes when the driver's JVM ends."""
    sc = spark.sparkContext
    home = f"{shared_dir(spark)}/orrery-{sc.applicationId}"
    if home not in _homes:
        path = sc._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _homes.add(home)
    return f"{home}/{uuid.uuid4().hex}"


_homes: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from a Parquet table in the shared folder."""
    spark, path = df.sparkSession, work_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., whatever their names were; functions over Arrow batches take no name with a dot."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, lengthened where ``taken`` has them already."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def whole_ids(docs: DataFrame, *names: str) -> None:
    """Ids are whole numbers; a column of another type is an error before anything runs."""
    for n in names:
        if not isinstance(docs.schema[n].dataType, T.IntegralType):
            raise TypeError(f"{n} must hold whole numbers, not {docs.schema[n].dataType.simpleString()}")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` in at least as many partitions as there are cores, where a plain scan of few row groups would leave most idle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if re.search("Join|Aggregate|Window|Repartition|Sort|Limit|Union|Generate|Distinct|LocalRelation|LogicalRDD|Arrow|Pandas|InMemory", plan):
        return docs
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def digest(col: str | Column) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(F.col(col) if isinstance(col, str) else col))


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the contents of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word the index of its distinct word; 64-bit hashes of the distinct words; those words."""
    import xxhash

    coded = pa.array(words, pa.binary() if words and isinstance(words[0], bytes) else pa.string()).dictionary_encode()
    distinct = coded.dictionary
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return coded.indices.to_numpy(zero_copy_only=False), hashes, distinct


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that a Python worker holds little at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key``, one table for each of its values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of bigint ``edges`` as ``(node, root)``, root the least node.

    Large and small stars by turns; every round is a few shuffles over the edges that
    are left, and its result is written to the shared folder before the next one reads it.
    Nulls are dropped, loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    state = cut(pairs)
    seen = None
    while True:
        # large star: every larger neighbour of a node is linked to the least in its neighbourhood
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u > v").distinct()
        state = cut(small)
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
