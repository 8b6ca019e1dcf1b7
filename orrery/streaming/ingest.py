"""A directory of log files folded by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def stream_log(spark: SparkSession, directory: str, schema: T.StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Every batch of new log files goes to ``apply(frame, batch_id)`` until none is left.

    A batch may come again after a failure under the same number; ``apply`` writes to a place named by it.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
