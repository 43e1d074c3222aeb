"""What the operators share: table access, the shared work folder and column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[Workspace] = []


@contextlib.contextmanager
def finished_workspaces():
    """Remove the workspaces that were made in this block when it ends: what was read from them has been written."""
    first = len(_made)
    try:
        yield
    finally:
        while len(_made) > first:
            _made.pop().drop()


class Workspace:
    """Tables that cut an operator's lineage, as Parquet in the shared folder.

    A lost executor costs only the tasks it ran: finished tables are re-read from the shared store.
    drop() removes them once the operator's result has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _made.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = self.path(name), df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, df: DataFrame | None = None) -> None:
        """Remove the whole workspace, or the one table that df reads."""
        jvm = self.spark._jvm
        for root in df.inputFiles()[:1] if df is not None else [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path = path.getParent() if df is not None else path
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of at most ARROW_ROWS rows, unless the session has less.

    A batch of whole texts takes its size several times over, in the JVM's buffers and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


_held: dict = {}


def held(name, make: Callable):
    """What make() gives, kept in this worker process until something of another name is asked for.

    A worker serves one operator after another; so it holds the memo of one of them at a time.
    """
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Give back what this worker holds, to the system too."""
    if _held:
        _held.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give the system back what this worker has freed; it would keep that while idle."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, made from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle, whatever size the planner takes it for.

    That counts neither the rows that explode makes of one nor what Parquet has packed, and would have the driver
    build a broadcast many times the threshold.
    """
    return df.hint("merge")


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, else to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else shuffled(df)


def only(rows: DataFrame, ids: DataFrame, column: str, most: int = 250_000) -> DataFrame:
    """The rows whose integer id is among ids: in place if the ids are few enough to broadcast, else by a shuffle."""
    return rows.join(small(ids.distinct(), most), column, "left_semi")
