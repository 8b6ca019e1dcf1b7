"""The corpus pipeline: documents to token ids, in five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.bpe import encode_stage
from orrery.llm.common import cut
from orrery.llm.mixing import mix_stage
from orrery.llm.repeats import remove_stage
from orrery.llm.simhash import dedup_stage
from orrery.llm.toxicity import reject_stage

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", reject_stage),
    ("simhash near-dedup", dedup_stage),
    ("suffix-array dedup", remove_stage),
    ("mixing to target weights", mix_stage),
    ("byte-level bpe", encode_stage),
]

#: SQL cannot express the stages; tests/llm/test_llm.py holds run() against all five written out by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each kept is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
