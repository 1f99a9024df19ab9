"""The catalog: tables as lists of immutable Parquet segments, views, functions, triggers, users and grants.

A statement writes new segments and a new catalog; publishing it adds the next version's manifest, which only one
writer can, whatever process it runs in. Nothing that a DataFrame may still read is changed, so earlier results stay
what they were. Folders and manifests go through Hadoop's file system: the store must be local or have a rename that
fails where the target exists, as HDFS does; an object store without one is not safe for several writers.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
import secrets
import threading
import uuid
from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.plans.lexer import SqlError

#: A version's catalog; as many old ones stay for readers that are about to open them.
MANIFEST, KEPT = re.compile(r"manifest-(\d+)\.json"), 20
EMPTY = {"version": 0, "tables": {}, "indexes": {}, "views": {}, "functions": {}, "triggers": {}, "users": {}, "grants": [], "owners": {}}
SPARK_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


class Locks:
    """Shared and exclusive table locks of all sessions on one store; a conflict fails at once."""

    def __init__(self):
        self.guard, self.readers, self.writer = threading.Lock(), defaultdict(set), {}

    def read(self, table: str, who: str) -> None:
        with self.guard:
            if self.writer.get(table, who) != who:
                raise SqlError(f"lock conflict: {table} is being written by another transaction")
            self.readers[table].add(who)

    def write(self, table: str, who: str) -> None:
        with self.guard:
            if self.writer.get(table, who) != who or self.readers[table] - {who}:
                raise SqlError(f"lock conflict: {table} is in use by another transaction")
            self.writer[table] = who

    def release(self, who: str, reads_only: bool = False) -> None:
        with self.guard:
            for readers in self.readers.values():
                readers.discard(who)
            if not reads_only:
                self.writer = {t: w for t, w in self.writer.items() if w != who}


_LOCKS: dict[str, Locks] = defaultdict(Locks)


class Store:
    """Files of one database."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.locks = spark, root.rstrip("/"), _LOCKS[root.rstrip("/")]
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """The versions whose manifests are there, ascending."""
        folder = self._path("")
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := MANIFEST.fullmatch(n)))

    def load(self) -> dict:
        while have := self.versions():
            path = self._path(f"manifest-{have[-1]}.json")
            try:
                stream = path.getFileSystem(self.conf).open(path)
            except Py4JJavaError:  # cleaned away meanwhile: there is a later one
                if self.versions() == have:
                    raise
                continue
            try:
                return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return copy.deepcopy(EMPTY)

    def publish(self, catalog: dict, expected: int) -> None:
        """Add the manifest of the next version in one step, if no other writer has: a link or rename that fails where
        the name is taken, so of several drivers exactly one wins and the others have a conflict."""
        conflict = "commit conflict: the database changed since this transaction began"
        if self.load()["version"] != expected:
            raise SqlError(conflict)
        catalog["version"] = expected + 1
        temp, final = self._path(f"temp-{uuid.uuid4().hex}.json"), self._path(f"manifest-{expected + 1}.json")
        fs = temp.getFileSystem(self.conf)
        out = fs.create(temp)
        out.write(bytearray(json.dumps(catalog, indent=1).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
                self.jvm.java.nio.file.Files.createLink(local(final), local(temp))
            else:
                options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(temp), fs.makeQualified(final), options)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise SqlError(conflict) from None
            raise
        finally:
            fs.delete(temp, False)
        old = self._path(f"manifest-{expected + 1 - KEPT}.json")
        if expected + 1 > KEPT:
            fs.delete(old, False)

    def write(self, df: DataFrame, table: dict) -> str:
        """A new segment, sorted or with a bloom filter as the table's indexes ask; its path below the root."""
        name = f"segments/{uuid.uuid4().hex}"
        kinds = {i["column"]: i["using"] for i in table.get("indexes", [])}
        ordered = [c for c, using in kinds.items() if using == "BTREE"]
        if ordered:
            df = df.sortWithinPartitions(*ordered)  # narrow min/max statistics: scans skip row groups
        writer = df.write
        for c, using in kinds.items():
            if using == "HASH":
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{name}")
        return name

    def read(self, table: dict) -> DataFrame:
        """The table's rows. A column added after a segment was written is NULL in it; renamed ones keep their stored name."""
        fields = table["columns"]
        stored = T.StructType([T.StructField(f["stored"], SPARK_TYPES[f["type"]]) for f in fields])
        if table["segments"]:
            df = self.spark.read.schema(stored).parquet(*[f"{self.root}/{s}" for s in table["segments"]])
        else:
            df = self.spark.createDataFrame([], stored)
        return df.toDF(*[f["name"] for f in fields])

    def unread(self, catalog: dict) -> None:
        """Delete segments that no manifest names; for maintenance, when no result is still being read."""
        used = {s for t in catalog["tables"].values() for s in t["segments"]}
        folder = self._path("segments")
        fs = folder.getFileSystem(self.conf)
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                if f"segments/{status.getPath().getName()}" not in used:
                    fs.delete(status.getPath(), True)


def verifier(password: str, salt: str | None = None) -> dict:
    salt = salt or secrets.token_hex(8)
    return {"salt": salt, "hash": hashlib.sha256((salt + password).encode()).hexdigest()}


def column_of(table: dict, name: str) -> dict:
    for c in table["columns"]:
        if c["name"].lower() == name.lower():
            return c
    raise SqlError(f"no such column: {name}")
