"""Where jobs keep their intermediate tables, and how Arrow batches are cut."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at once.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends here, and any executor can read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, underscored until no column of the frames is called so, in whatever case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a stored id table up to which it is broadcast (16 MB of longs); beyond it joins shuffle.
BROADCAST_IDS = 1 << 21


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if its size allows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Rows of a small table that a task takes.
TASK_ROWS = 1 << 16


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df, of about so many rows, in a task for each `each` of them (one for each core at least), however many shuffle partitions there are."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // each))


_kept: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that a stage's tables don't stay while other stages run."""
    if key not in _kept:
        released()
        _kept[key] = make()
    return _kept[key]


def released() -> None:
    """Give what this Python worker kept or freed back to the system; called where a task's kernel begins and ends."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets into them) for runs of rows of about `limit` bytes; null counts as empty.

    A row longer than the limit forms a run of its own, so no text is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
