"""Small helpers the operators share: Arrow maps, bounded broadcasts, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import SLICE, give_back, materialise, short_batches

#: Rows, and bytes by Spark's own estimate (for a written table its files), up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Rows of a task that writes a table whose size is known before.
TASK_ROWS = 20_000
#: Text handed to one numpy pass, whose arrays take about fifty times as much.
CHUNK_BYTES = 1 << 19


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, else as it is.

    Pass a written table: counting it reads footers only, and its size is known from its files.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def written(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The frame as a table in the shared folder: a lineage cut that survives lost executors.

    With ``most``, rows it has at most, its last step has a task per core or per ``TASK_ROWS`` of them and no more: a small
    table is not written by one task per shuffle partition."""
    if most is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_ROWS)))
    return materialise(df, f"llm-{name}")


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with a function built once per task by ``make``; it gets up to ``SLICE`` rows. ``done`` ends a task.

    Workers live on after a task, so they give back what it no longer needs.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield step(batch.slice(at, SLICE))
        step = batch = None
        if done:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column with about ``most`` bytes each (one longer text is a run of its own).

    Gives first row, end row, the UTF-8 bytes of the run and the rows' byte offsets in it. Null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    for part in runs(offsets, most):
        end = first + len(part) - 1
        yield first, end, data[part[0] : part[-1]], part - part[0]
        first = end


def runs(offsets: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The offsets of runs of rows with about ``most`` bytes each."""
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield offsets[first : end + 1]
        first = end
