"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text handed to a Python worker at once; documents are long and uneven.
BATCH_ROWS, BATCH_BYTES = "500", "4m"

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def session(df: DataFrame) -> SparkSession:
    """The session of df, set to hand text to Python in bounded batches."""
    spark = df.sparkSession
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:  # the session may be older than this module, and its workers need it
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, *known) if x)
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    return spark


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that gives memory back: workers outlive their tasks.

    Large arrays are mapped on their own rather than kept in the heap, and what is free is returned when the task ends.
    """

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else follows the largest array freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)

    return tidied


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    """The GNU C library, where that is the one in use."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt") else None
    except OSError:
        return None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a temporary folder stands in for it, if the master is this machine alone; else that is an error.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_to:
        return set_to
    held = getattr(spark.sparkContext, "_tracewright_shared", None)
    if held is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(held)
        spark.sparkContext._tracewright_shared = held
    return held


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, compressed, and read from there: cuts lineage with less disk than cut().

    The files stay until release(), as a DataFrame that is still to run may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    keep_until_release(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_release(spark: SparkSession, path: str) -> None:
    """Notes a path in the shared folder for release()."""
    held = getattr(spark.sparkContext, "_tracewright_held", None)
    if held is None:
        held = spark.sparkContext._tracewright_held = []
    held.append(path)


def mark(spark: SparkSession) -> int:
    """A point in time for release()."""
    return len(getattr(spark.sparkContext, "_tracewright_held", []))


def release(spark: SparkSession, start: int, end: int) -> None:
    """Deletes what was stored between two marks. Only when nothing that is still to run reads it."""
    held = getattr(spark.sparkContext, "_tracewright_held", [])
    jvm = spark.sparkContext._jvm
    for i in range(start, min(end, len(held))):
        if held[i]:
            path = jvm.org.apache.hadoop.fs.Path(held[i])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            held[i] = None


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Text of a text column; null counts as empty."""
    return [x.decode("utf-8", "replace") for x in as_bytes(column)]
