"""What the corpus operators share: staged tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Folders that :func:`new_path` has handed out: nothing else is ever deleted.
_OWN: set[str] = set()
_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    """Staged tables of the scopes that this thread has open, innermost last."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local (single-machine tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _OWN.add(_qualified(spark, path)[0])
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks it ran, and values that depend on task
    order (such as generated integers) are fixed from here on.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    if _scopes():
        _scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _qualified(spark: SparkSession, folder: str):
    """(the folder's name with its file system, path, file system)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString(), path, store


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this process; any other stays."""
    name, path, store = _qualified(spark, folder)
    if name in _OWN:
        store.delete(path, True)
        _OWN.discard(name)


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads. Tables that were not staged here stay, wherever they lie."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; results that need them have to be written before."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            _delete(spark, path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Stage what ``make`` returns; what it staged on the way is deleted."""
    path = new_path(spark, tag)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    if _scopes():
        _scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def parts_for(df: DataFrame, size, each: int) -> int:
    """Into how many parts rows have to be dealt so that each has about ``each`` of the sum of ``size`` (a column)."""
    return max(1, -(-(df.agg(F.sum(size)).first()[0] or 0) // each))


#: Rows that cross to a Python worker at a time where the session has Spark's own default: texts are long, and a batch is held on both sides.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, unless it was set to something else than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def utf8_slices(column: pa.Array, most_bytes: int = 1 << 20):
    """Yield (first row, last row, byte buffer, offsets) over runs of rows of about ``most_bytes``.

    A null reads as an empty text. One row may exceed ``most_bytes``; it then forms its own run.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
