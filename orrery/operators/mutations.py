"""Documents from a log of upserts, patches and deletes.

A log has ``seq`` and ``op_idx`` (its order), ``id``, ``op``, and for each attribute a column of values; ``set``, an array of names, says which
attributes an operation mentions, so that a patch can clear one by mentioning it with null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import InvalidWrite
from orrery.operators.filters import Filter, flag

UPSERT, PATCH, DELETE = "upsert", "patch", "delete"


def fold(log: DataFrame, attributes: list[str], id_col: str = "id", dead: bool = False) -> DataFrame:
    """The live documents: for each id the last upsert or delete resets it, and what comes after is laid over by attribute.
    With ``dead`` those that were deleted are there too, and a column ``deleted`` tells them.

    One aggregate by id, which combines before its shuffle and holds one value of each attribute however long an id's history is.
    A delete followed by patches recreates the document.
    """
    pos = F.struct("seq", "op_idx")
    mentioned = lambda a: F.array_contains("set", a) & (F.col("op") != DELETE)
    # a mention is kept as a struct, so that a cleared attribute differs from one not mentioned
    cells = [F.max_by(F.when(mentioned(a), F.struct(pos.alias("p"), F.col(f"`{a}`").alias("v"))), F.when(mentioned(a), pos)).alias(f"_c{i}") for i, a in enumerate(attributes)]
    last = log.groupBy(id_col).agg(F.max_by("op", pos).alias("_last"), F.max(F.when(F.col("op") != PATCH, pos)).alias("_reset"), *cells)
    gone = F.col("_last") == DELETE
    live = lambda c: F.when(F.col("_reset").isNull() | (F.col(f"{c}.p") >= F.col("_reset")), F.col(f"{c}.v"))
    return (last if dead else last.where(~gone)).select(id_col, *(live(f"_c{i}").alias(a) for i, a in enumerate(attributes)), *([gone.alias("deleted")] if dead else []))


def newest(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """Of the versions of each id the one with the greatest ``order``; tombstones (``deleted``) are dropped."""
    packed = F.struct(*[c for c in rows.columns if c != id_col])
    best = rows.groupBy(id_col).agg(F.max_by(packed, order).alias("r")).select(id_col, "r.*")
    return best.where("NOT deleted").drop("deleted") if "deleted" in rows.columns else best


def overlay(base: DataFrame, ops: DataFrame, attributes: list[str], id_col: str = "id", parts: int | None = None, dead: bool = False) -> DataFrame:
    """``base`` with later operations laid over: a base row counts as the first upsert of its id.  ``parts`` is the number of tasks that fold."""
    first = base.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("op_idx"), F.col(id_col), F.lit(UPSERT).alias("op"), *attributes, F.array(*map(F.lit, attributes)).alias("set"))
    log = first.unionByName(ops.select("seq", F.col("op_idx").cast("int"), id_col, "op", *attributes, "set"))
    return fold(log.repartition(parts, id_col) if parts else log, attributes, id_col, dead)


def conditional(state: DataFrame, ops: DataFrame, condition: Filter | list[Filter | None], id_col: str = "id") -> DataFrame:
    """``ops`` with ``applied``: whether the row there is meets the condition.  Without a row an upsert applies, a patch or delete doesn't.

    Where conditions are a list, a column ``cond`` of ``ops`` says which one an operation has; one without a condition applies always.
    """
    every = condition if isinstance(condition, list) else [condition]
    flags = [F.lit(True) if c is None else flag(c, state.schema) for c in every]
    there = state.select(F.col(id_col).alias("_id"), F.array(*flags).alias("_ok"))
    joined = ops.join(there, ops[id_col] == there["_id"], "left")
    which = F.col("cond") if isinstance(condition, list) else F.lit(0)
    free = F.array(*(F.lit(c is None) for c in every))[which]
    return joined.withColumn("applied", free | F.when(F.col("_id").isNull(), F.col("op") == UPSERT).otherwise(F.col("_ok")[which])).drop("_id", "_ok")


def outcome(tried: DataFrame) -> DataFrame:
    """One row: rows affected, upserted, patched and deleted, and how many were skipped."""
    n = lambda op: F.count_if(F.col("applied") & (F.col("op") == op))
    return tried.agg(F.count_if("applied").alias("affected"), n(UPSERT).alias("upserted"), n(PATCH).alias("patched"), n(DELETE).alias("deleted"), F.count_if(~F.col("applied")).alias("skipped"))


def select_for_write(state: DataFrame, where: Filter, max_rows: int | None, partial: bool, id_col: str = "id") -> tuple[DataFrame, bool]:
    """Ids that a write by filter touches, and whether rows remain.  More than ``max_rows`` is an error unless ``partial``, which takes the first by id;
    without ``max_rows`` every row that matches is written."""
    matching = state.where(flag(where, state.schema)).select(id_col)
    over = max_rows is not None and matching.count() > max_rows  # each task counts its own; a limit would pass the rows through one
    if over and not partial:
        raise InvalidWrite(f"more than {max_rows} rows match")
    return (matching.orderBy(id_col).limit(max_rows) if over else matching), over
