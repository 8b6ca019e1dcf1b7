"""Tokens and their statistics, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKEN_BYTES = 39
_RUN = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: str | Column, max_bytes: int = MAX_TOKEN_BYTES, lowercase: bool = True) -> Column:
    """Runs of letters and digits, lowered sign by sign; a token longer than ``max_bytes`` is dropped, not cut."""
    found = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    # a capital sigma is small sigma at the end of a word too, where lower() would look at its place
    lowered = F.transform(found, lambda t: F.lower(F.translate(t, "Σ", "σ"))) if lowercase else found
    return F.filter(lowered, lambda t: F.octet_length(t) <= max_bytes)


def column_tokens(df: DataFrame, column: str) -> Column:
    """Tokens of a string column, or of all the strings of an array column."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.flatten(F.transform(F.filter(column, lambda s: s.isNotNull()), lambda s: tokens(s)))
    return tokens(F.col(column))


def tokenize_query(spark: SparkSession, text: str) -> list[str]:
    """The tokens of a query's text, by the expression that documents are split with."""
    return list(spark.sql("SELECT 1").select(tokens(F.lit(text))).first()[0])


def token_rows(df: DataFrame, id_col: str, column: str, *keep: str | Column) -> DataFrame:
    """``id_col``, ``keep`` and ``_t``, the tokens; a generator holds them, so that the optimizer doesn't repeat the split wherever they are named."""
    return df.select(id_col, *keep, F.explode(F.array(column_tokens(df, column))).alias("_t"))


def term_frequencies(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """``(id_col, term, tf)``."""
    return df.select(id_col, F.explode(column_tokens(df, column)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(df: DataFrame, column: str) -> DataFrame:
    """``(doc_count, total_len)`` over the documents that have a token in the column."""
    return df.select(F.size(column_tokens(df, column)).alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_len"))
