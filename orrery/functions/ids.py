"""Ids of documents: whole numbers of 64 bits, signed or not, or text, of which UUIDs sort first."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidWrite

#: Types of an id column: numbers, numbers of unsigned 64 bits, UUIDs and other text.
BIGINT, U64, TEXT = "bigint", "decimal(20,0)", "string"
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
MAX_TEXT = 64


def kind_of(id_: Any) -> str:
    """The id column's type that a first id asks for."""
    if isinstance(id_, bool) or not isinstance(id_, (int, str)):
        raise InvalidWrite(f"{id_!r} is not an id")
    if isinstance(id_, str):
        return TEXT
    return BIGINT if -(2**63) <= id_ < 2**63 else U64


def normal(id_: Any, kind: str) -> Any:
    """An id as it is stored: UUIDs in small letters.  One of another kind than the collection's is an error."""
    own = kind_of(id_)
    if kind == TEXT:
        if own != TEXT or not 1 <= len(id_.encode()) <= MAX_TEXT:
            raise InvalidWrite(f"{id_!r} is not a text of 1 to {MAX_TEXT} bytes")
        return id_.lower() if re.match(UUID, id_) else id_
    if own == TEXT or own == U64 and kind == BIGINT or kind == U64 and not 0 <= id_ < 2**64:
        raise InvalidWrite(f"{id_!r} is not a {kind}")
    return id_


def normal_column(id_: Column, kind: str) -> Column:
    """The same for a column."""
    if kind == TEXT:
        text = id_.cast("string")
        return F.when(text.rlike(UUID), F.lower(text)).otherwise(text)
    return id_.cast(kind)


def ascending(df: DataFrame, id_col: str) -> list[Column]:
    """The order of ids: numbers by size; UUIDs, then other text, by their bytes."""
    x = F.col(id_col)
    return [(~x.rlike(UUID)).asc(), x.asc()] if isinstance(df.schema[id_col].dataType, T.StringType) else [x.asc()]


def descending(df: DataFrame, id_col: str) -> list[Column]:
    x = F.col(id_col)
    return [(~x.rlike(UUID)).desc(), x.desc()] if isinstance(df.schema[id_col].dataType, T.StringType) else [x.desc()]


def sort_key(id_: Column) -> Column:
    """Of a whole number: a tag and its eight bytes, greatest first, which sort as the numbers do; in hexadecimal digits."""
    return F.concat(F.lit("01"), F.lpad(F.hex(id_.cast("long")), 16, "0"))


def route(key: str) -> int:
    """FNV-1a of a name's bytes, by which names are dealt to places."""
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = ((h ^ b) * 0x100000001B3) & ((1 << 64) - 1)
    return h
