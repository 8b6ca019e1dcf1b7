"""Control objects on any Hadoop file system: whole reads, ranges, exclusive creation, replacement, listing.

Names are relative to a root and hold no part that leads out of it.  What was read of an object that never changes may be kept, up to a
number of bytes; requests and bytes are counted.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter, OrderedDict
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from orrery.errors import AlreadyExists, CasMismatch, InvalidWrite, NotFound

_PART = re.compile(r"[^/\x00]+")


_homes: set[str] = set()


def work_path(spark: SparkSession, name: str = "") -> str:
    """A new path in a folder of this application's own, under the one that ``spark.checkpoint.dir`` names; it goes when the driver's JVM ends.

    Where the session names none, one machine's own temporary folder serves if that machine is all there is; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    given = spark.conf.get("spark.checkpoint.dir", None) or (None if current.isEmpty() else current.get())
    if given is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="orrery-")
    if current.isEmpty():
        sc.setCheckpointDir(given)
    home = f"{given}/orrery-{sc.applicationId}"
    if home not in _homes:
        path = sc._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _homes.add(home)
    return f"{home}/{name}{uuid.uuid4().hex}"


class Storage:
    def __init__(self, spark: SparkSession, root: str, cache_bytes: int = 0):
        self.spark, self.cache_bytes, self.meter = spark, cache_bytes, Counter()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self._path(root)
        self._fs = at.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(at).toString().rstrip("/")
        self._io, self._jvm = jvm.org.apache.commons.io.IOUtils, jvm
        self._kept: OrderedDict[str, bytes] = OrderedDict()

    def path(self, name: str = "") -> str:
        """The object's whole path, for Spark to read or write."""
        parts = name.split("/") if name else []
        if any(not _PART.fullmatch(p) or p in (".", "..") for p in parts):
            raise InvalidWrite(f"bad name {name!r}")
        return "/".join([self.root, *parts])

    def _at(self, name: str):
        return self._path(self.path(name))

    def exists(self, name: str) -> bool:
        self.meter["heads"] += 1
        return self._fs.exists(self._at(name))

    def size(self, name: str) -> int:
        """Bytes of an object, or of all under it."""
        self.meter["heads"] += 1
        return self._fs.getContentSummary(self._at(name)).getLength()

    def get(self, name: str, immutable: bool = False) -> bytes:
        if name in self._kept:
            self._kept.move_to_end(name)
            self.meter["hits"] += 1
            return self._kept[name]
        try:
            stream = self._fs.open(self._at(name))
        except Py4JJavaError as e:
            if "FileNotFound" in str(e.java_exception.getClass().getName()):
                raise NotFound(name) from None
            raise
        try:
            data = bytes(self._io.toByteArray(stream))
        finally:
            stream.close()
        self.meter["gets"] += 1
        self.meter["bytes_read"] += len(data)
        if immutable and len(data) <= self.cache_bytes:
            self._kept[name] = data
            while sum(map(len, self._kept.values())) > self.cache_bytes:
                self._kept.popitem(last=False)
        return data

    def get_range(self, name: str, start: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``start``."""
        if not self.exists(name):
            raise NotFound(name)
        stream = self._fs.open(self._at(name))
        try:
            stream.seek(start)
            data = bytes(self._io.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()
        self.meter["gets"] += 1
        self.meter["bytes_read"] += len(data)
        return data

    def _write(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(data)
        finally:
            stream.close()
        self.meter["puts"] += 1
        self.meter["bytes_written"] += len(data)

    def _rename(self, source: str, target: str, over: bool) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE if over else rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(source).toUri(), self._conf).rename(self._at(source), self._at(target), kinds)

    def put(self, name: str, data: bytes) -> None:
        """Written aside, then put in its place, so that no reader sees a part of it."""
        spare = f"{name}.{uuid.uuid4().hex}"
        self._write(spare, data)
        self._rename(spare, name, True)
        self._kept.pop(name, None)

    def put_if_absent(self, name: str, data: bytes) -> None:
        """The same where nothing is there yet; else an error."""
        if self.exists(name):
            raise AlreadyExists(name)
        spare = f"{name}.{uuid.uuid4().hex}"
        self._write(spare, data)
        try:
            if urlparse(self.root).scheme in ("", "file"):
                import os

                where = lambda n: unquote(urlparse(self.path(n)).path)
                os.link(where(spare), where(name))  # fails if another got there in between
                self.delete(spare)
            else:
                self._rename(spare, name, False)
        except (FileExistsError, Py4JJavaError) as e:
            self.delete(spare)
            if isinstance(e, Py4JJavaError) and "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            raise AlreadyExists(name) from None

    def compare_and_set(self, name: str, expected: bytes | None, data: bytes) -> None:
        """``data`` in place of ``expected``; an error if something else is there.  Writers of one object agree on who they are by an exclusive creation before."""
        now = self.get(name) if self.exists(name) else None
        if now != expected:
            self.meter["mismatches"] += 1
            raise CasMismatch(name)
        self.put(name, data)

    def list(self, name: str = "") -> list[str]:
        """Names of what lies directly in a folder."""
        self.meter["lists"] += 1
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if not n.endswith(".crc"))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str) -> None:
        self.meter["deletes"] += 1
        self._fs.delete(self._at(name), True)
        self._kept.pop(name, None)

    def copy(self, source: str, target: str) -> None:
        """An object, or all under it, from a whole path."""
        at = self._path(source)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(at.getFileSystem(self._conf), at, self._fs, self._at(target), False, self._conf)

    def metrics(self) -> DataFrame:
        """``(counter, n)`` of the requests so far."""
        return self.spark.createDataFrame(sorted(self.meter.items()), "counter string, n long")
