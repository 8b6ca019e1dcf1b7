"""A stored inverted table of attributes: ``(column, value, id)``, by column, sorted by value, so that lookups and ranges read a part of it.

Values keep their type, in one of three columns, and sort as themselves; of an array every element is a value.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.filters import Eq, Range, compile_filter

_TYPED = {"number": "double", "text": "string", "flag": "boolean"}


def _cell(name: str, value: Column, t: T.DataType) -> Column:
    own = "number" if isinstance(t, T.NumericType) else "flag" if isinstance(t, T.BooleanType) else "text"
    return F.struct(F.lit(name).alias("column"), *((value if k == own else F.lit(None)).cast(kind).alias(k) for k, kind in _TYPED.items()))


def _maker(name: str, t: T.DataType):
    return lambda x: _cell(name, x, t)


def postings(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(column, number, text, flag, id)``, in one pass over ``df``; missing values have no row, and an id has one for equal elements of an array."""
    parts = []
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, T.ArrayType):
            parts.append(F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast(t))), _maker(c, t.elementType)))
        else:
            parts.append(F.when(F.col(c).isNotNull(), F.array(_cell(c, F.col(c), t))))
    cells = F.flatten(F.array_compact(F.array(*parts)))
    return df.select(F.col(id_col).alias("id"), F.explode(cells).alias("c")).select("c.*", "id")


@dataclass(frozen=True)
class AttributeIndex:
    spark: SparkSession
    path: str

    @staticmethod
    def build(df: DataFrame, id_col: str, columns: list[str], path: str) -> AttributeIndex:
        """Sorted by value in ranges that split a hot value by id."""
        rows = postings(df, id_col, columns)
        by = ["column", "number", "text", "flag", "id"]
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("column").parquet(path)
        return AttributeIndex(df.sparkSession, path)

    def _rows(self, column: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("column") == column)

    def _find(self, column: str, f: Eq | Range) -> DataFrame:
        kind = next(("flag" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text") for v in ([f.value] if isinstance(f, Eq) else [b[0] for b in (f.lower, f.upper) if b]))
        rows = self._rows(column)
        leaf = Eq(kind, f.value) if isinstance(f, Eq) else Range(kind, f.lower, f.upper)
        return rows.where(compile_filter(leaf, rows.schema)).select("id").distinct()

    def ids_for_eq(self, column: str, value: Any) -> DataFrame:
        return self._find(column, Eq(column, value))

    def ids_for_range(self, column: str, lower: tuple[Any, bool] | None = None, upper: tuple[Any, bool] | None = None) -> DataFrame:
        return self.all_ids(column) if lower is None and upper is None else self._find(column, Range(column, lower, upper))

    def all_ids(self, column: str) -> DataFrame:
        return self._rows(column).select("id").distinct()
