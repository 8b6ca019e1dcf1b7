"""Documents from JSON text, whose columns and types are inferred from all of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidSchema


def _type(text: str, top: bool = False) -> T.DataType:
    """Spark's name of a JSON value's type as a column's: numbers with a point are doubles, nothing but nulls is text."""
    text = text.strip()
    if top and (m := re.fullmatch(r"OBJECT<(.*)>", text, re.S)):
        fields, depth, at = [], 0, 0
        body = m[1]
        for i, c in enumerate(body + ","):
            depth += (c in "<(") - (c in ">)")
            if c == "," and depth == 0:
                if body[at:i].strip():
                    name, kind = body[at:i].strip().split(": ", 1)
                    fields.append(T.StructField(name.strip("`"), _type(kind)))
                at = i + 1
        return T.StructType(fields)
    if m := re.fullmatch(r"ARRAY<(.*)>", text, re.S):
        inner = _type(m[1])
        if isinstance(inner, T.ArrayType):
            raise InvalidSchema("arrays don't hold arrays")
        return T.ArrayType(inner)
    kinds = {"BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(), "VOID": T.StringType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType()}
    if text in kinds:
        return kinds[text]
    if text.startswith("DECIMAL"):
        whole = re.fullmatch(r"DECIMAL\((\d+),0\)", text)
        return T.LongType() if whole and int(whole[1]) <= 18 else T.DoubleType()
    raise InvalidSchema(f"{text} is not a value's type")


def documents(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``keep`` and a column for each key of the objects in ``json_col``, null where an object lacks it.  One pass finds the types, a second reads."""
    found = df.agg(F.schema_of_variant_agg(F.parse_json(json_col))).first()[0]
    kind = _type(found or "OBJECT<>", True)
    if not isinstance(kind, T.StructType):
        raise InvalidSchema("a document is an object")
    return df.select(*keep, F.from_json(json_col, kind).alias("_d")).select(*keep, *(F.col(f"_d.`{f.name}`").alias(f.name) for f in kind))
