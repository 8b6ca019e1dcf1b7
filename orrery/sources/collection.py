"""A collection on any Hadoop file system: a log of batches, immutable Parquet snapshots and indexes, and a manifest for each generation.

A batch is written by Spark and becomes visible by a record of it, created exclusively under its number.  A snapshot is
published by writing its manifest, exclusively under its generation, then replacing the pointer ``CURRENT``.  Readers open what their manifest names
and no listing of data decides what is visible.  Rows never pass through the driver but for lists of operations that it was given.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import AlreadyExists, Backpressure, CasMismatch, Corrupt, IdempotencyConflict, InvalidQuery, InvalidSchema, InvalidWrite, NotFound
from orrery.functions import ids as id_kinds
from orrery.functions import vectors as vector_functions
from orrery.operators import filters, ivf, mutations
from orrery.operators.filters import Filter
from orrery.operators.textindex import TextIndex
from orrery.plans.query import MAX_QUERIES, Indexes, Query, Result, execute
from orrery.sources.storage import Storage

MAX_COLUMNS, MAX_VECTORS, MAX_DIMENSIONS, MAX_NAME, MAX_UNINDEXED = 1024, 2, 10_752, 128, 2 << 30
PATCH_ROWS, DELETE_ROWS, TIER_RUNS, COMPACT_RUNS, COMPACT_APPENDS = 50_000, 5_000_000, 4, 8, 4
#: Rows and bytes of Parquet that one task folds by id, so that its memory stays the same whatever the collection's size.
PART_ROWS, PART_BYTES = 1 << 18, 16 << 20
_NAME = re.compile(r"[A-Za-z0-9\-_.]{1,128}")


def parse_value(text: str) -> Any:
    """A value from a command line: whole number, float, boolean, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)


def infer(value: Any) -> str | None:
    """Spark type of an attribute's value; an empty array has none."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise InvalidSchema("an integer has 64 bits")
        return "bigint"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise InvalidSchema("a float is finite")
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        kinds = {infer(v) for v in value}
        if any(k is None or k.startswith("array") for k in kinds):
            raise InvalidSchema("arrays don't hold arrays")
        if len(kinds) > 1:
            raise InvalidSchema("an array holds one type")
        return f"array<{kinds.pop()}>" if kinds else None
    raise InvalidSchema(f"{type(value).__name__} is not a value")


@dataclass(frozen=True)
class Snapshot:
    """A manifest, and the number of the last batch that counts."""

    manifest: dict
    commit: int


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _dump(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, default=str).encode()


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, cache_bytes: int = 1 << 20):
        if not _NAME.fullmatch(name) or name in (".", ".."):
            raise InvalidWrite(f"bad name {name!r}")
        self.spark, self.name, self.root = spark, name, root
        self.store = Storage(spark, f"{root.rstrip('/')}/{name}", cache_bytes)

    # ------------------------------------------------------------ control objects

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, ids: str | None = None, vectors: dict[str, dict] | None = None, text: tuple[str, ...] = ()) -> Collection:
        """A new collection.  ``ids`` is the type of its ids, by default that of the first batch; ``vectors`` says by column what else the first batch would
        (``dim``, ``metric``, ``encoding`` f32 or f16); ``text`` names the columns that get a text index."""
        c = cls(spark, root, name)
        known = {k: {"dim": v.get("dim"), "metric": v.get("metric", "cosine"), "encoding": v.get("encoding", "f32")} for k, v in (vectors or {}).items()}
        if len(known) > MAX_VECTORS or any(v["metric"] not in vector_functions.METRICS or v["encoding"] not in ("f32", "f16") for v in known.values()) or ids not in (None, id_kinds.BIGINT, id_kinds.U64, id_kinds.TEXT):
            raise InvalidSchema("an unknown metric, encoding or type of ids, or too many vectors")
        c._publish({"generation": 0, "indexed": 0, "indexed_bytes": 0, "schema": {}, "version": 0, "vectors": known, "ids": ids, "text": list(text), "docs": [], "indexes": {"text": {}, "vector": {}}}, None)
        return c

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str) -> Collection:
        c = cls(spark, root, name)
        if not c.store.exists("CURRENT"):
            raise NotFound(name)
        return c

    @classmethod
    def create_or_open(cls, spark: SparkSession, root: str, name: str, **options: Any) -> Collection:
        try:
            return cls.create(spark, root, name, **options)
        except AlreadyExists:
            return cls.open(spark, root, name)

    def _publish(self, manifest: dict, before: bytes | None) -> None:
        """``before`` is the pointer that the new manifest was made from."""
        body = _dump(manifest)
        self.store.put_if_absent(f"manifest/{manifest['generation']}.json", body)  # two writers can't publish one generation
        self.store.compare_and_set("CURRENT", before, _dump({"generation": manifest["generation"], "sha256": hashlib.sha256(body).hexdigest()}))

    def manifest(self) -> dict:
        pointer = json.loads(self.store.get("CURRENT"))
        body = self.store.get(f"manifest/{pointer['generation']}.json", immutable=True)
        if hashlib.sha256(body).hexdigest() != pointer["sha256"]:
            raise Corrupt("the manifest does not match its digest")
        return json.loads(body)

    def _record(self, seq: int) -> dict:
        return json.loads(self.store.get(f"wal/{seq}.json", immutable=True))

    def commit(self, manifest: dict | None = None) -> int:
        """The last batch's number."""
        seqs = [int(n[:-5]) for n in self.store.list("wal") if re.fullmatch(r"\d+\.json", n)]
        return max([*seqs, (manifest or self.manifest())["indexed"]])

    def snapshot(self) -> Snapshot:
        m = self.manifest()
        return Snapshot(m, self.commit(m))

    def _strong(self) -> Snapshot:
        """A snapshot to read; too much that isn't indexed is an error, as it is for writes."""
        snap = self.snapshot()
        if self.unindexed_bytes(snap) > MAX_UNINDEXED:
            raise Backpressure("too much isn't indexed yet")
        return snap

    @contextlib.contextmanager
    def reading(self, seconds: float = 600) -> Iterator[Snapshot]:
        """A snapshot whose files no collector of garbage takes until the block ends or the time is up."""
        snap, name = self.snapshot(), f"leases/{uuid.uuid4().hex}.json"
        self.store.put(name, _dump({"generation": snap.manifest["generation"], "expires": time.time() + seconds}))
        try:
            yield snap
        finally:
            self.store.delete(name)

    # ------------------------------------------------------------ schema

    def _state(self, snap: Snapshot | None = None) -> dict:
        """Schema, vectors and type of ids as of the last batch, which every record has whole."""
        snap = snap or self.snapshot()
        return self._record(snap.commit) if snap.commit > snap.manifest["indexed"] else snap.manifest

    def schema(self, snap: Snapshot | None = None) -> tuple[dict[str, str], dict[str, dict]]:
        state = self._state(snap)
        return dict(state["schema"]), {k: dict(v) for k, v in state["vectors"].items()}

    def _checked(self, attrs: dict, vecs: dict) -> None:
        names = [*attrs, *vecs]
        if len(names) > MAX_COLUMNS or len(vecs) > MAX_VECTORS or len(set(names)) < len(names) or any(n.startswith("$") or not 0 < len(n.encode()) <= MAX_NAME for n in names):
            raise InvalidSchema("too many columns, or a bad name")

    def _extend(self, ops: list[dict], state: dict) -> tuple[dict[str, str], dict[str, dict], str | None]:
        attrs, vecs, ids = dict(state["schema"]), {k: dict(v) for k, v in state["vectors"].items()}, state["ids"]
        kinds = {id_kinds.kind_of(op["id"]) for op in ops}
        ids = ids or (None if not kinds else id_kinds.TEXT if id_kinds.TEXT in kinds else id_kinds.U64 if id_kinds.U64 in kinds else id_kinds.BIGINT)
        for op in ops:
            id_kinds.normal(op["id"], ids)
            if op["op"] not in (mutations.UPSERT, mutations.PATCH, mutations.DELETE):
                raise InvalidWrite(f"unknown operation {op['op']}")
            for k, v in op.get("attributes", {}).items():
                if v is None:
                    if op["op"] != mutations.PATCH:
                        raise InvalidSchema("null stands in patches only")
                    continue
                kind = infer(v)
                if kind is None:
                    if not attrs.get(k, "").startswith("array"):
                        raise InvalidSchema(f"an empty array can't make column {k}")
                elif attrs.setdefault(k, kind) != kind:
                    raise InvalidSchema(f"{k} is {attrs[k]}, not {kind}")
            for k, v in op.get("vectors", {}).items():
                own = vecs.setdefault(k, {"dim": None, "metric": "cosine", "encoding": "f32"})
                own["dim"] = own["dim"] or len(v)
                if any(infer(float(x)) != "double" for x in v) or not 1 <= len(v) <= MAX_DIMENSIONS or own["dim"] != len(v):
                    raise InvalidSchema(f"{k}: a vector of the column's dimensions is needed")
                if own["encoding"] == "f16" and any(abs(float(x)) >= 65520 for x in v):
                    raise InvalidSchema(f"{k}: a number is too large for half precision")
        self._checked(attrs, vecs)
        return attrs, vecs, ids

    @staticmethod
    def _kinds(attrs: dict, vecs: dict) -> dict[str, str]:
        return {**attrs, **dict.fromkeys(vecs, "array<float>")}

    def _columns(self, snap: Snapshot) -> tuple[list[str], T.StructType]:
        state = self._state(snap)
        kinds = self._kinds(state["schema"], state["vectors"])
        text = "".join(f", `{c}` {k}" for c, k in kinds.items())
        return list(kinds), T.StructType.fromDDL(f"seq bigint, op_idx int, id {state['ids'] or id_kinds.BIGINT}, op string, `set` array<string>{text}")

    # ------------------------------------------------------------ writes

    def append(self, ops: list[dict], key: str | None = None, bulk: bool = False) -> dict:
        """One atomic batch.  The same ``key`` with the same operations gives the first outcome again; with others it is a conflict."""
        return self._once(key, _sha("append" + json.dumps(ops, sort_keys=True)), lambda held: self._append(ops, held, bulk))

    def _append(self, ops: list[dict], held: str | None, bulk: bool = False, more: dict | None = None) -> dict:
        attrs, vecs, ids = self._extend(ops, self._state())
        kinds = self._kinds(attrs, vecs)
        rows = []
        for i, op in enumerate(ops):
            cells = {**op.get("attributes", {}), **{k: [float(x) for x in v] for k, v in op.get("vectors", {}).items()}}
            own = id_kinds.normal(op["id"], ids)
            rows.append((i, Decimal(own) if ids == id_kinds.U64 else own, op["op"], list(kinds if op["op"] == mutations.UPSERT else cells), *(cells.get(c) for c in kinds)))
        text = "".join(f", `{c}` {k}" for c, k in kinds.items())
        frame = self.spark.createDataFrame(rows, f"op_idx int, id {ids or id_kinds.BIGINT}, op string, `set` array<string>{text}").coalesce(1)
        return self._commit(frame, attrs, vecs, ids, kinds, held, bulk, more)

    def append_frame(self, rows: DataFrame, key: str | None = None, bulk: bool = False) -> dict:
        """One atomic batch from a table that no driver holds: ``id``, ``op``, and a column for each attribute; arrays of float are vectors.

        An upsert sets every column and a patch those that aren't null, or those in a column ``set`` where there is one.  Where an
        id occurs more than once a column ``op_idx`` gives the order.  A ``key`` stands for the table's content.
        """
        return self._append_frame(rows, key, None, bulk)

    def _append_frame(self, rows: DataFrame, key: str | None, held: str | None, bulk: bool, more: dict | None = None) -> dict:
        whole = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
        kinds = {c: whole.get(k, k) for c, k in rows.dtypes if c not in ("id", "op", "op_idx", "set")}
        state = self._state()
        attrs, vecs = dict(state["schema"]), {k: dict(v) for k, v in state["vectors"].items()}
        given = rows.schema["id"].dataType
        ids = state["ids"] or (id_kinds.TEXT if isinstance(given, T.StringType) else id_kinds.U64 if isinstance(given, T.DecimalType) else id_kinds.BIGINT)
        if (ids == id_kinds.TEXT) != isinstance(given, T.StringType):
            raise InvalidWrite(f"ids are {ids}, not {given.simpleString()}")
        for c, k in kinds.items():
            if k == "array<float>":
                vecs.setdefault(c, {"dim": None, "metric": "cosine", "encoding": "f32"})
                continue
            if k.removeprefix("array<").removesuffix(">") not in ("bigint", "double", "string", "boolean"):
                raise InvalidSchema(f"{c}: {k} is not a value")
            if attrs.setdefault(c, k) != k:
                raise InvalidSchema(f"{c} is {attrs[c]}, not {k}")
        self._checked(attrs, vecs)
        every = list({**attrs, **dict.fromkeys(vecs)})
        named = F.col("set") if "set" in rows.columns else F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in kinds))) if kinds else F.array().cast("array<string>")
        set_ = F.when(F.col("op") == mutations.UPSERT, F.array(*map(F.lit, every)).cast("array<string>")).when(F.col("op") == mutations.PATCH, named).otherwise(F.array().cast("array<string>"))
        order = F.col("op_idx").cast("int") if "op_idx" in rows.columns else F.lit(0)
        frame = rows.select(order.alias("op_idx"), id_kinds.normal_column(F.col("id"), ids).alias("id"), "op", set_.alias("set"), *(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))
        return self._commit(frame, attrs, vecs, ids, kinds, held, bulk, more, key)

    def _commit(self, frame: DataFrame, attrs: dict, vecs: dict, ids: str | None, kinds: dict, held: str | None, bulk: bool, more: dict | None = None, content_key: str | None = None) -> dict:
        """Stage the batch, check what was staged, then make it visible."""
        state, snap = self._state(), self.snapshot()
        seq = snap.commit + 1
        for c, v in vecs.items():
            if v["encoding"] == "f16" and c in kinds:
                frame = frame.withColumn(c, vector_functions.half(F.col(f"`{c}`")))
        name = f"wal/{seq}-{uuid.uuid4().hex}.parquet"
        frame.withColumn("seq", F.lit(seq).cast("long")).write.parquet(self.store.path(name))
        try:
            return self._admit(name, seq, state, snap, attrs, vecs, ids, kinds, held, bulk, more, content_key)
        except (InvalidWrite, InvalidSchema, IdempotencyConflict, Backpressure, CasMismatch):  # none is raised once the batch is visible
            self.store.delete(name)
            raise

    def _admit(self, name: str, seq: int, state: dict, snap: Snapshot, attrs: dict, vecs: dict, ids: str | None, kinds: dict, held: str | None, bulk: bool, more: dict | None, content_key: str | None) -> dict:
        there = self.spark.read.parquet(self.store.path(name))
        op = F.col("op")
        unsound = ~op.isin(mutations.UPSERT, mutations.PATCH, mutations.DELETE) | op.isNull() | F.col("id").isNull() | F.col("op_idx").isNull()
        if ids == id_kinds.TEXT:
            unsound = unsound | ~F.octet_length("id").between(1, id_kinds.MAX_TEXT)
        bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
        infinite = F.lit(False)
        for c, k in kinds.items():
            value = F.col(f"`{c}`")
            infinite = infinite | F.coalesce(bad(value) if k == "double" else F.exists(value, lambda x: x.isNull() | bad(x)) if k in ("array<double>", "array<float>") else F.lit(False), F.lit(False))
        dims = [c for c, k in kinds.items() if k == "array<float>"]
        sizes = [f(F.size(f"`{c}`")) for c in dims for f in (lambda x: F.min(F.when(x >= 0, x)), lambda x: F.max(F.when(x >= 0, x)))]
        mark = F.sum(F.xxhash64("op_idx", "id", "op", F.concat_ws("\0", "set"), *(f"`{c}`" for c in kinds)).cast("decimal(38,0)"))
        counts = [F.count_if(op == o) for o in (mutations.UPSERT, mutations.PATCH, mutations.DELETE)]
        n, wrong, odd, print_, up, patched, deleted, *sizes = there.agg(F.count(F.lit(1)), F.count_if(unsound), F.count_if(infinite), mark, *counts, *sizes).first()

        def admit(held: str | None) -> dict:
            bytes_ = self.store.size(name)
            own = there.select("id", "op_idx").repartition(self._parts([{"rows": n, "bytes": bytes_}]), "id")
            if wrong or not own.groupBy("id", "op_idx").count().where("count > 1").isEmpty():
                raise InvalidWrite("an unknown operation, no id, or an id that occurs twice without an order")
            for c, least, most in zip(dims, sizes[::2], sizes[1::2]):
                if most is not None:
                    vecs[c]["dim"] = vecs[c]["dim"] or most
                    if least != most or not 1 <= most <= MAX_DIMENSIONS or vecs[c]["dim"] != most:
                        raise InvalidSchema(f"{c}: a vector of the column's dimensions is needed")
            if odd:
                raise InvalidSchema("a float that isn't finite")
            if self.unindexed_bytes(snap) + bytes_ > MAX_UNINDEXED and not (bulk and not patched):
                raise Backpressure("too much isn't indexed yet")
            outcome = {"seq": seq, "affected": n, "upserted": up, "patched": patched, "deleted": deleted, **(more or {})}
            if not n:
                self.store.delete(name)
                return outcome | {"seq": snap.commit}
            total = (state["total"] if "total" in state else state["indexed_bytes"]) + bytes_
            version = state["version"] + (attrs != state["schema"] or vecs != state["vectors"])
            record = {"seq": seq, "file": name, "schema": attrs, "vectors": vecs, "ids": ids, "version": version, "bytes": bytes_, "total": total, "rows": n, "key": held, "outcome": outcome}
            try:
                self.store.put_if_absent(f"wal/{seq}.json", _dump(record))  # the batch is visible from here on
            except AlreadyExists:
                raise CasMismatch(f"another writer has made batch {seq}") from None
            return outcome

        if content_key is None:
            return admit(held)
        before = self.commit()
        outcome = self._once(content_key, _sha(json.dumps([n, str(print_), sorted(kinds.items())])), admit)
        if outcome["seq"] <= before:
            self.store.delete(name)
        return outcome

    def _once(self, key: str | None, fingerprint: str, write: Callable[[str | None], dict]) -> dict:
        """``write``'s outcome, or that of an earlier write under ``key``.

        The key is reserved before anything is written, and a batch's record names it, so that after a crash at any point a retry finds the batch
        that became visible, or writes it.
        """
        if key is None:
            return write(None)
        if not 1 <= len(key.encode()) <= 256:
            raise InvalidWrite("a key has 1 to 256 bytes")
        hashed = _sha(key)
        name = f"idempotency/{hashed}.json"
        try:
            self.store.put_if_absent(name, _dump({"fingerprint": fingerprint, "from": self.commit()}))
        except AlreadyExists:
            held = json.loads(self.store.get(name))
            if held["fingerprint"] != fingerprint:
                raise IdempotencyConflict(key) from None
            if "outcome" in held:
                return held["outcome"]
            for seq in range(held["from"] + 1, self.commit() + 1):
                if self.store.exists(f"wal/{seq}.json") and self._record(seq)["key"] == hashed:
                    self.store.put(name, _dump(held | {"outcome": self._record(seq)["outcome"]}))
                    return self._record(seq)["outcome"]
        try:
            outcome = write(hashed)
        except (InvalidWrite, Backpressure):
            self.store.delete(name)  # nothing was written
            raise
        self.store.put(name, _dump({"fingerprint": fingerprint, "from": 0, "outcome": outcome}))
        return outcome

    def append_if(self, ops: list[dict], condition: Filter | None = None, key: str | None = None) -> dict:
        """Each operation applies if the row there meets its own ``condition`` (a filter or its JSON form), or else the common one; all are checked, applied or not."""
        of = lambda op: filters.parse(op["condition"]) if isinstance(op.get("condition"), dict) else op.get("condition", condition)

        def write(held: str | None) -> dict:
            state = self._state()
            _, _, ids = self._extend(ops, state)
            own = [id_kinds.normal(op["id"], ids) for op in ops]
            if len(set(own)) < len(own):
                raise InvalidWrite("an id occurs twice")
            conditions = list(dict.fromkeys(map(of, ops)))
            rows = [(Decimal(i) if ids == id_kinds.U64 else i, op["op"], n, conditions.index(of(op))) for n, (i, op) in enumerate(zip(own, ops))]
            frame = self.spark.createDataFrame(rows, f"id {ids or id_kinds.BIGINT}, op string, n int, cond int")
            tried = {r.n: r.applied for r in mutations.conditional(self.df(), frame, conditions).collect()} if ops else {}  # the operations given
            done = [op for i, op in enumerate(ops) if tried[i]]
            more = {"applied_ids": sorted(op["id"] for op in done), "skipped_ids": sorted(op["id"] for i, op in enumerate(ops) if not tried[i])}
            return self._append(done, held, more=more)

        return self._once(key, _sha("append_if" + json.dumps([[{k: v for k, v in op.items() if k != "condition"}, repr(of(op))] for op in ops], sort_keys=True)), write)

    def _by_filter(self, where: Filter, op: str, attributes: dict, max_rows: int | None, partial: bool, key: str | None) -> dict:
        def write(held: str | None) -> dict:
            attrs, _, _ = self._extend([{"id": 0, "op": op, "attributes": attributes}], self._state() | {"ids": None})
            chosen, remain = mutations.select_for_write(self.df(), where, max_rows, partial)
            cells = [F.lit(v).cast(attrs[c]).alias(c) for c, v in attributes.items() if c in attrs]
            frame = chosen.select("id", F.lit(op).alias("op"), *cells, F.array(*map(F.lit, attributes)).cast("array<string>").alias("set"))
            return self._append_frame(frame, None, held, False, {"rows_remaining": remain})

        return self._once(key, _sha(op + "_by_filter" + json.dumps([repr(where), attributes, max_rows, partial], sort_keys=True)), write)

    def patch_by_filter(self, where: Filter, attributes: dict, max_rows: int | None = PATCH_ROWS, partial: bool = False, key: str | None = None) -> dict:
        """Patches every row that passes, by a batch that Spark writes; ``batch`` reads which.  More than ``max_rows`` is an error, or with ``partial`` left over; None is no limit."""
        return self._by_filter(where, mutations.PATCH, attributes, max_rows, partial, key)

    def delete_by_filter(self, where: Filter, max_rows: int | None = DELETE_ROWS, partial: bool = False, key: str | None = None) -> dict:
        return self._by_filter(where, mutations.DELETE, {}, max_rows, partial, key)

    # ------------------------------------------------------------ reads

    def batch(self, seq: int) -> DataFrame:
        """The operations of one batch."""
        return self.spark.read.parquet(self.store.path(self._record(seq)["file"]))

    def overlay(self, snap: Snapshot | None = None) -> DataFrame:
        """The operations that no snapshot holds yet."""
        snap = snap or self.snapshot()
        _, kind = self._columns(snap)
        files = [self.store.path(self._record(s)["file"]) for s in range(snap.manifest["indexed"] + 1, snap.commit + 1)]
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def _runs(self, snap: Snapshot, runs: list[dict]) -> DataFrame:
        names, kind = self._columns(snap)
        whole = T.StructType([kind["id"], T.StructField("deleted", T.BooleanType()), T.StructField("run", T.LongType()), *(f for f in kind if f.name in names)])
        return self.spark.read.schema(whole).parquet(*(r["path"] for r in runs)) if runs else self.spark.createDataFrame([], whole)

    @staticmethod
    def _parts(some: list[dict]) -> int:
        """The tasks that fold these runs or batches by id."""
        return 1 + max(sum(x["rows"] for x in some) // PART_ROWS, sum(x["bytes"] for x in some) // PART_BYTES)

    def _late(self, snap: Snapshot) -> list[dict]:
        return [self._record(s) for s in range(snap.manifest["indexed"] + 1, snap.commit + 1)]

    def base(self, snap: Snapshot | None = None) -> DataFrame:
        """The newest version of each row in the snapshot's runs; deletions stand in the newer runs."""
        snap = snap or self.snapshot()
        names, _ = self._columns(snap)
        runs = snap.manifest["docs"]
        rows = self._runs(snap, runs)
        return (mutations.newest(rows.repartition(self._parts(runs), "id"), "id", "run").drop("run") if len(runs) > 1 else rows.where("NOT deleted").drop("deleted", "run")).select("id", *(f"`{c}`" for c in names))

    def df(self, snap: Snapshot | None = None) -> DataFrame:
        """Every document as of the last batch."""
        snap = snap or self._strong()
        names, _ = self._columns(snap)
        if snap.commit == snap.manifest["indexed"]:
            return self.base(snap)
        return mutations.overlay(self.base(snap), self.overlay(snap), names, parts=self._parts([*snap.manifest["docs"], *self._late(snap)]))

    def get(self, *ids: Any) -> DataFrame:
        kind = self._state()["ids"] or id_kinds.BIGINT
        own = [id_kinds.normal(i, kind) for i in ids]
        return self.df().where(F.col("id").isin(*(map(Decimal, own) if kind == id_kinds.U64 else own)))

    def indexes(self, snap: Snapshot | None = None) -> Indexes:
        """What the snapshot's manifest names, and what was written since."""
        snap = snap or self.snapshot()
        m, late = snap.manifest, snap.commit > snap.manifest["indexed"]
        text = {} if late else {c: TextIndex(self.spark, x["path"], x["doc_count"], x["total_len"], m["ids"] or id_kinds.BIGINT) for c, x in m["indexes"]["text"].items()}
        vector = {c: ivf.Index(self.spark, "id", c, x["metric"], x["centroids"], tuple(map(tuple, x["tables"])), tuple(map(tuple, x["touched"]))) for c, x in m["indexes"]["vector"].items()}
        _, vecs = self.schema(snap)
        gone = self.overlay(snap).select("id").distinct() if late and vector else None
        fresh = self.df(snap).join(gone, "id", "left_semi") if gone is not None else None
        return Indexes(vector, text, {c: v["metric"] for c, v in vecs.items()}, {c: v["dim"] for c, v in vecs.items() if v["dim"]}, fresh, gone)

    def query(self, request: dict | Query, snap: Snapshot | None = None) -> Result:
        snap = snap or self._strong()
        return execute(self.df(snap), "id", request if isinstance(request, Query) else Query.parse(request), self.indexes(snap))

    def multi_query(self, requests: list[dict | Query]) -> list[Result]:
        """Up to 16 requests over one snapshot."""
        if not 1 <= len(requests) <= MAX_QUERIES:
            raise InvalidQuery(f"between 1 and {MAX_QUERIES} queries")
        snap = self._strong()
        return [self.query(r, snap) for r in requests]

    def recall(self, column: str, num: int = 25, k: int = 10, probes: int | None = None, keep: Filter | None = None) -> DataFrame:
        """Recall of approximate searches, for sampled rows; the column needs a published index."""
        own = self.indexes()
        if column not in own.vector:
            raise InvalidQuery(f"{column} has no published index")
        if filters.whole_arrays(keep):
            raise InvalidQuery("a filter on whole arrays is answered exactly")
        return ivf.recall(own.vector[column], num, k, probes, None, keep, own.fresh, own.gone)

    def unindexed_bytes(self, snap: Snapshot | None = None) -> int:
        snap = snap or self.snapshot()
        return self._record(snap.commit)["total"] - snap.manifest["indexed_bytes"] if snap.commit > snap.manifest["indexed"] else 0

    def metadata(self) -> DataFrame:
        """One row: cursors, runs, rows and bytes (each version of a row counts), schema, vectors, and which indexes there are."""
        snap = self.snapshot()
        m, state = snap.manifest, self._state(snap)
        late = self._late(snap)
        row = (self.name, m["generation"], m["indexed"], snap.commit, snap.commit - m["indexed"], len(m["docs"]), sum(r["rows"] for r in m["docs"]) + sum(r["rows"] for r in late), sum(r["bytes"] for r in m["docs"]) + sum(r["bytes"] for r in late))
        row += (self.unindexed_bytes(snap), state["ids"], state["version"], _dump(state["schema"]).decode(), _dump(state["vectors"]).decode(), sorted(m["indexes"]["text"]), sorted(m["indexes"]["vector"]))
        return self.spark.createDataFrame([row], "name string, generation long, indexed long, committed long, lag long, runs int, approx_rows long, approx_bytes long, unindexed_bytes long, ids string, schema_version long, schema string, vectors string, text_indexes array<string>, vector_indexes array<string>")

    def warm(self, budget: int = 64 << 20) -> list[str]:
        """Keep what fits ``budget`` bytes in the executors' memory, vector indexes first, then text indexes, then documents; says which."""
        own, m, kept = self.indexes(), self.manifest(), []
        parts = [(f"vector {c}", [p for p, _ in x.tables]) for c, x in own.vector.items()] + [(f"text {c}", [x.path]) for c, x in own.text.items()] + [(f"docs {i}", [r["path"]]) for i, r in enumerate(reversed(m["docs"]))]
        for name, paths in parts:
            need = sum(self._bytes(p) for p in paths)
            if need <= budget:
                budget -= need
                for p in paths:
                    self.spark.read.parquet(p).persist(StorageLevel.MEMORY_AND_DISK).count()
                kept.append(name)
        return kept

    def _bytes(self, path: str) -> int:
        at = self.store._path(path)
        return at.getFileSystem(self.store._conf).getContentSummary(at).getLength()

    # ------------------------------------------------------------ snapshots

    def _write_run(self, rows: DataFrame, generation: int, level: int) -> dict:
        target = self.store.path(f"docs/{generation}-{uuid.uuid4().hex}")
        rows.withColumn("run", F.lit(generation).cast("long")).sortWithinPartitions("id").write.parquet(target)
        return {"path": target, "run": generation, "level": level, "rows": self.spark.read.parquet(target).count(), "bytes": self._bytes(target)}

    def _text_indexes(self, snap: Snapshot, generation: int) -> dict:
        out, (attrs, _) = {}, self.schema(snap)
        for c in snap.manifest["text"]:
            if attrs.get(c) in ("string", "array<string>"):
                x = TextIndex.build(self.base(snap), "id", c, self.store.path(f"index/text-{generation}-{uuid.uuid4().hex}"))
                out[c] = {"path": x.path, "doc_count": x.doc_count, "total_len": x.total_len}
        return out

    @staticmethod
    def _as_json(x: ivf.Index) -> dict:
        return {"metric": x.metric, "centroids": x.centroids, "tables": x.tables, "touched": x.touched}

    def _vector_indexes(self, snap: Snapshot, generation: int, run: dict | None) -> dict:
        """``run`` is appended to the indexes there are; without it they are built anew."""
        own, out, (_, vecs) = self.indexes(snap), {}, self.schema(snap)
        for c, v in vecs.items():
            path = self.store.path(f"index/vector-{generation}-{uuid.uuid4().hex}")
            if run is not None and c in own.vector:
                rows = self._runs(snap, [run])
                out[c] = self._as_json(own.vector[c].append(rows.where("NOT deleted").drop("deleted", "run"), path, generation, run["path"]))
            else:
                x = ivf.Index.build(self.base(snap), "id", c, path, v["metric"], version=generation)
                if x.centroids:
                    out[c] = self._as_json(x)
        return out

    def flush(self) -> int:
        """The overlay becomes a run of whole documents and deletions, and the indexes follow.  One aggregate by id makes both."""
        snap, before = self.snapshot(), self.store.get("CURRENT")
        m = snap.manifest
        if snap.commit == m["indexed"]:
            return m["generation"]
        state, generation = self._state(snap), m["generation"] + 1
        late, (names, _) = self._late(snap), self._columns(snap)
        base, touched, parts = self.base(snap), self.overlay(snap).select("id"), self._parts([*m["docs"], *late])
        if m["docs"]:
            few = self._parts(late) == 1
            base = (base if few else base.repartition(parts, "id")).join(F.broadcast(touched) if few else touched.repartition(parts, "id"), "id", "left_semi")
        run = self._write_run(mutations.overlay(base, self.overlay(snap), names, parts=parts if m["docs"] else self._parts(late), dead=True), generation, 0)
        m = m | {"generation": generation, "indexed": snap.commit, "indexed_bytes": state["total"], "schema": state["schema"], "version": state["version"], "vectors": state["vectors"], "ids": state["ids"], "docs": [*m["docs"], run]}
        new = Snapshot(m, snap.commit)
        self._publish(m | {"indexes": {"text": self._text_indexes(new, generation), "vector": self._vector_indexes(new, generation, run)}}, before)
        return generation

    def compact(self) -> int:
        """All runs become one, without deletions, and the indexes are built anew."""
        self.flush()
        snap, before = self.snapshot(), self.store.get("CURRENT")
        generation = snap.manifest["generation"] + 1
        run = self._write_run(self.base(snap).withColumn("deleted", F.lit(False)), generation, 1 + max((r["level"] for r in snap.manifest["docs"]), default=0))
        m = snap.manifest | {"generation": generation, "docs": [run]}
        new = Snapshot(m, snap.commit)
        self._publish(m | {"indexes": {"text": self._text_indexes(new, generation), "vector": self._vector_indexes(new, generation, None)}}, before)
        return generation

    def tier(self, least: int = TIER_RUNS) -> int:
        """``least`` runs or more of one level, the lowest first, become one of the next; deletions are kept."""
        snap, before = self.snapshot(), self.store.get("CURRENT")
        m = snap.manifest
        for level in sorted({r["level"] for r in m["docs"]}):
            own = [r for r in m["docs"] if r["level"] == level]
            if len(own) < least:
                continue
            generation = m["generation"] + 1
            rows = self._runs(snap, own)
            packed = F.struct(*(f"`{c}`" for c in rows.columns if c != "id"))
            best = rows.repartition(self._parts(own), "id").groupBy("id").agg(F.max_by(packed, "run").alias("r")).select("id", "r.*").drop("run")
            run = self._write_run(best, max(r["run"] for r in own), level + 1)
            self._publish(m | {"generation": generation, "docs": sorted([r for r in m["docs"] if r not in own] + [run], key=lambda r: r["run"])}, before)
            return generation
        return m["generation"]

    def maintain_vectors(self, column: str) -> str:
        """One task for a column that is indexed whole: a cluster of more than twice its share is split in two, one of less than half of it merged
        into its nearest neighbours, else rows that lie nearer to another centroid are moved.  Says what was done."""
        snap, before = self.snapshot(), self.store.get("CURRENT")
        if snap.commit > snap.manifest["indexed"] or column not in self.indexes(snap).vector:
            return "nothing"
        own, generation = self.indexes(snap).vector[column], snap.manifest["generation"] + 1
        path = self.store.path(f"index/vector-{generation}-{uuid.uuid4().hex}")
        tasks = own.plan().where("action <> 'keep'").orderBy("action", F.col("n").desc(), "cluster_id").collect()  # 16 clusters at most
        split = next((r.cluster_id for r in tasks if r.action == "split"), None)
        merge = next((r.cluster_id for r in reversed(tasks) if r.action == "merge"), None)
        if split is not None and len(own.centroids) < ivf.MAX_CLUSTERS:
            done, new = "split", own.rebuild([split], 2, path, generation)
        elif merge is not None and len(own.centroids) > 1:
            near = [c for c in own.neighbours(merge, 1)]
            done, new = "merge", own.rebuild(near, 1, path, generation)
        elif not own.reassign().isEmpty():
            done, new = "reassign", own.moved(path, generation)
        else:
            return "nothing"
        indexes = snap.manifest["indexes"]
        self._publish(snap.manifest | {"generation": generation, "indexes": indexes | {"vector": indexes["vector"] | {column: self._as_json(new)}}}, before)
        return done

    def maintain(self) -> str:
        """One step of upkeep: everything is compacted at 8 runs or 4 appends to a vector index; else runs are tiered; else a vector index gets a task."""
        m = self.manifest()
        if len(m["docs"]) >= COMPACT_RUNS or any(len(x["tables"]) > COMPACT_APPENDS for x in m["indexes"]["vector"].values()):
            self.compact()
            return "compact"
        if self.tier() != m["generation"]:
            return "tier"
        for c in m["indexes"]["vector"]:
            if (done := self.maintain_vectors(c)) != "nothing":
                return f"{done} {c}"
        return "nothing"

    def branch(self, name: str) -> Collection:
        """A new collection over the same snapshot files, with a log of its own."""
        snap = self.snapshot()
        if snap.commit != snap.manifest["indexed"]:
            raise InvalidWrite("flush before a branch")
        return self._child(self.root, name, snap.manifest)

    def _child(self, root: str, name: str, manifest: dict) -> Collection:
        child = Collection.create(self.spark, root, name)
        child._publish(manifest | {"generation": child.manifest()["generation"] + max(1, manifest["generation"]), "indexed": 0, "indexed_bytes": 0}, child.store.get("CURRENT"))
        return child

    def copy_to(self, root: str, name: str) -> Collection:
        """Documents and log, copied by the executors; indexes are built by the copy's next flush or compaction."""
        snap = self.snapshot()
        child, m = Collection(self.spark, root, name), snap.manifest
        if child.store.exists("CURRENT"):
            raise AlreadyExists(name)
        copied = []
        for r in m["docs"]:
            target = child.store.path(f"docs/{r['run']}-{uuid.uuid4().hex}")
            self.spark.read.parquet(r["path"]).write.parquet(target)
            copied.append(r | {"path": target})
        child = self._child(root, name, m | {"docs": copied, "indexes": {"text": {}, "vector": {}}})
        total = 0
        for n, seq in enumerate(range(m["indexed"] + 1, snap.commit + 1), 1):
            record = self._record(seq)
            file = f"wal/{n}-{uuid.uuid4().hex}.parquet"
            self.batch(seq).withColumn("seq", F.lit(n).cast("long")).write.parquet(child.store.path(file))
            total += record["bytes"]
            child.store.put_if_absent(f"wal/{n}.json", _dump(record | {"seq": n, "file": file, "total": total, "key": None}))
        return child

    def export_to(self, target: str) -> dict:
        """Parquet and, last, a catalogue with each file's digest, which the executors make."""
        snap = self._strong()
        self.df(snap).write.parquet(f"{target}/data")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{target}/data")
        listed = {r.name: r.sha for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()}  # a row for each file
        catalog = {"name": self.name, "commit": snap.commit, "files": listed}
        Storage(self.spark, target).put("catalog.json", _dump(catalog))
        return catalog

    def gc(self, apply: bool = False) -> list[str]:
        """Files that no manifest in force here or in a branch names, nor one under a reader's lease."""
        here = Storage(self.spark, self.root)
        used: set[str] = set()
        for name in here.list():
            if not _NAME.fullmatch(name) or not here.exists(f"{name}/CURRENT"):
                continue
            other = Collection(self.spark, self.root, name)
            manifests = [other.manifest()]
            for lease in other.store.list("leases"):
                held = json.loads(other.store.get(f"leases/{lease}"))
                if held["expires"] > time.time():
                    manifests.append(json.loads(other.store.get(f"manifest/{held['generation']}.json")))
            for m in manifests:
                used |= {r["path"] for r in m["docs"]} | {x["path"] for x in m["indexes"]["text"].values()}
                used |= {p for x in m["indexes"]["vector"].values() for p, _ in [*x["tables"], *x["touched"]]}
        snap = self.snapshot()
        dead = [f"{d}/{n}" for d in ("docs", "index") for n in self.store.list(d) if self.store.path(f"{d}/{n}") not in used]
        live = {self._record(s)["file"] for s in range(snap.manifest["indexed"] + 1, snap.commit + 1)}
        dead += [f"wal/{n}" for n in self.store.list("wal") if n.endswith(".parquet") and f"wal/{n}" not in live]
        for name in dead if apply else ():
            self.store.delete(name)
        return sorted(dead)
