"""What the operators of this subpackage share: the shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import ctypes.util
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A session on one machine (as in tests) may have none:
    then a temporary folder is made, set as the checkpoint folder and removed at exit. On a cluster that is an
    error, since other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
    path = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: its lineage ends there,
    and the loss of an executor costs nothing that is already written."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _let_go(spark)
    return out


_LAST_LET_GO = [0.0]


def _let_go(spark: SparkSession, every: float = 3.0) -> None:
    """Nothing reads the shuffle files behind a written table again. Spark drops them once their owners are collected,
    which a driver with much free memory would put off until the disks are full; so that is asked for, not more
    often than each few seconds."""
    if time.monotonic() - _LAST_LET_GO[0] >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _LAST_LET_GO[0] = time.monotonic()


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, when no later step reads it."""
    for t in tables:
        drop_path(t.sparkSession, t.written_to)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def n_bytes(text: str) -> int:
    """The length of ``text`` in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(rows: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges ``[start, end)`` of rows of about ``limit`` bytes each, one row at least."""
    start = size = 0
    for i, row in enumerate(rows):
        own = n_bytes(row)
        if size and size + own > limit:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(rows):
        yield start, len(rows)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's cycle collector, which would walk through all that a worker remembers again and again, where
    many objects but no cycles are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def bound_batches(spark: SparkSession, most: int) -> None:
    """Let the session's Arrow batches hold at most ``most`` bytes (and one row): an executor keeps a task's batch several
    times over, outside its heap and in the worker. A lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def trim_memory() -> None:
    """Give what a worker has freed back to the system: workers live on between tasks, and beside them the
    executor's heap needs the room."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)
