"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``.

Each application has a folder of its own there, ``larkspur-<application id>``, so what a crashed driver leaves can be
told and removed. Tables made within ``scratch()`` go when it ends, but for those that are kept for a returned frame;
these go when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OPEN: set[str] = set()
_SCOPES: list[list[Table]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where none is set, a folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Table:
    """A DataFrame written as Parquet in the shared folder, so a lost executor only costs a reread."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/larkspur-{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        _OPEN.add(self.path)
        if _SCOPES:
            _SCOPES[-1].append(self)
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def keep(self) -> Table:
        """Not for the scope that made it, but for the one around it, or for the process."""
        if _SCOPES and self in _SCOPES[-1]:
            _SCOPES[-1].remove(self)
            if len(_SCOPES) > 1:
                _SCOPES[-2].append(self)
        return self

    def drop(self) -> None:
        """For tables that no returned DataFrame reads any more."""
        if self.path in _OPEN:
            _OPEN.discard(self.path)
            _remove(self.spark, self.path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Drops the tables made within it, whether it ends well or not, but for those kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for table in _SCOPES.pop():
            table.drop()


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_OPEN):
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
