"""Written tables that cut lineage, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session.  Where that is unset, a session on one machine (``local[n]``)
gets a temporary folder, and a session on a cluster is refused: its executors could not read the driver's folders.
Tables are Parquet, so a lost executor costs the rereading of files, never the recomputation of what made them; the
shuffle files of a table are removed as soon as it is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: set[Scratch] = set()
_OWNER: ContextVar[list[Scratch] | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """The tables of one call of an operator. They stay until they are released or the process ends, for results are lazy."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
        _MADE.add(self)
        if (mine := _OWNER.get()) is not None:
            mine.append(self)

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        at, before = f"{self.path}/{name}", self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")  # once the table is written, nothing reads its shuffle files
        try:
            frame.write.mode("overwrite").parquet(at)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(frame.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """For tables that nothing will read again."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        """Delete all of this call's tables: once the results that read them are written."""
        self._delete(self.path)
        _MADE.discard(self)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def owned() -> Iterator[list[Scratch]]:
    """Whose tables the calls inside make: the list can release them, and no one else's, later on."""
    mine: list[Scratch] = []
    token = _OWNER.set(mine)
    try:
        yield mine
    finally:
        _OWNER.reset(token)


@atexit.register
def _at_exit() -> None:
    for scratch in list(_MADE):
        try:
            if scratch.spark.sparkContext._jsc is not None:
                scratch.release()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
