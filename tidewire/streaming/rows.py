"""A source that hands out rows one after another and can be stopped and resumed at any row.

The rows of a folder's Parquet files, in order of file names, have positions 0, 1, 2, ...; a position is the stream's
offset. A batch is a range of positions, cut into ranges for tasks. As a batch source it takes equality filters on plain
columns and reads only rows that pass them; as a stream it takes one such filter as options and can stop after a number of
rows that pass.

    spark.dataSource.register(ArticleRows)
    spark.readStream.format("article_rows").schema(schema).options(path=..., batchRows=..., column=..., equals=..., maxRows=...).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows a task's range has about.
TASK_ROWS = 20_000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parquet_files(path: str) -> list[str]:
    """The files of a folder by name, or the one file."""
    system, where = _system(path)
    if system.get_file_info(where).type == fs.FileType.File:
        return [where]
    found = system.get_file_info(fs.FileSelector(where))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    """Rows ``low`` to ``high`` (excluded) by position."""

    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class Rows:
    """Rows by position; only footers are read up front, once."""

    def __init__(self, path: str):
        self.path, self.files = path, parquet_files(path)
        system, _ = _system(path)
        self.starts = [0]
        for name in self.files:
            with system.open_input_file(name) as file:
                self.starts.append(self.starts[-1] + pq.read_metadata(file).num_rows)

    @property
    def total(self) -> int:
        return self.starts[-1]

    def read(self, low: int, high: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of a range in order, from the row groups that hold them."""
        system, _ = _system(self.path)
        for name, start, end in zip(self.files, self.starts, self.starts[1:]):
            if end <= low or start >= high:
                continue
            with system.open_input_file(name) as source:
                file, at = pq.ParquetFile(source), start
                for group in range(file.num_row_groups):
                    size = file.metadata.row_group(group).num_rows
                    first, last = max(low, at), min(high, at + size)
                    if first < last:
                        table = file.read_row_group(group, columns=columns).slice(first - at, last - first)
                        yield from table.combine_chunks().to_batches()
                    at += size


def _passing(batch: pa.RecordBatch, wanted: list[tuple[str, object]]) -> np.ndarray:
    mask = np.ones(batch.num_rows, bool)
    for name, value in wanted:
        column = batch.column(batch.schema.get_field_index(name))
        mask &= pc.fill_null(pc.equal(column, pa.scalar(value, column.type)), False).to_numpy(zero_copy_only=False)
    return mask


def _serve(rows: Rows, part: Range, schema: StructType, wanted: list[tuple[str, object]]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    columns = list(dict.fromkeys([*schema.names, *(n for n, _ in wanted)]))
    for batch in rows.read(part.low, part.high, columns):
        kept = batch.filter(pa.array(_passing(batch, wanted)))
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(f.name)).cast(f.type) for f in arrow], schema=arrow)


def _ranges(low: int, high: int) -> list[Range]:
    cuts = [*range(low, high, TASK_ROWS), high]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:])]


class BatchReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.rows, self.schema, self.wanted = Rows(path), schema, []

    def pushFilters(self, filters: list[Filter]):
        for found in filters:
            if isinstance(found, EqualTo) and len(found.attribute) == 1 and found.attribute[0] in self.schema.names:
                self.wanted.append((found.attribute[0], found.value))
            else:
                yield found

    def partitions(self) -> list[InputPartition]:
        return _ranges(0, self.rows.total) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _serve(self.rows, partition, self.schema, self.wanted)


class StreamReader(DataSourceStreamReader):
    """Batches of ``batchRows`` positions; ends behind the last row, or behind the row that is the ``maxRows``-th to pass."""

    def __init__(self, options, schema: StructType):
        self.rows, self.schema = Rows(options["path"]), schema
        self.wanted = [(options["column"], options["equals"])] if "column" in options else []
        self.batch = int(options.get("batchRows", 50_000))
        self.most = int(options["maxRows"]) if "maxRows" in options else None
        self.first = int(options.get("fromRow", 0))
        self.at: int | None = None
        self.counted = {self.first: 0}

    def initialOffset(self) -> dict:
        return {"row": self.first}

    def _end(self, low: int) -> int:
        """Where the batch from ``low`` on ends; for a limit, the filter column of its rows is looked at."""
        high = min(low + self.batch, self.rows.total)
        if self.most is None:
            return high
        seen, at = self._seen(low), low
        for batch in self.rows.read(low, high, [n for n, _ in self.wanted] or [self.schema.names[0]]):
            passing = _passing(batch, self.wanted)
            left = self.most - seen
            if left <= 0:
                return at
            if int(passing.sum()) >= left:
                end = at + int(np.flatnonzero(passing)[left - 1]) + 1
                self.counted[end] = self.most
                return end
            seen, at = seen + int(passing.sum()), at + batch.num_rows
        self.counted[high] = seen
        return high

    def _seen(self, low: int) -> int:
        """Rows that passed before ``low``; counted anew once after a restart."""
        if low not in self.counted:
            names = [n for n, _ in self.wanted] or [self.schema.names[0]]
            self.counted[low] = sum(int(_passing(b, self.wanted).sum()) for b in self.rows.read(self.first, low, names))
        return self.counted[low]

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.first
        self.at = max(self.at, self._end(self.at))
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["row"])  # a restarted stream goes on behind what it had planned
        return _ranges(start["row"], end["row"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _serve(self.rows, partition, self.schema, self.wanted)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["row"])


class ArticleRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_rows"

    def schema(self) -> StructType:
        raise ValueError("give the schema of the rows")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, schema)


def article_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows as a frame; ``where`` conditions of the form column = value are applied while rows are read."""
    spark.dataSource.register(ArticleRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("article_rows").schema(schema).option("path", path).load()


def row_stream(spark: SparkSession, path: str, schema: StructType, batch_rows: int = 50_000, symbol: tuple[str, str] | None = None, most: int | None = None) -> DataFrame:
    """The rows as a stream; ``symbol`` is (column, value), ``most`` ends the stream after so many rows that pass."""
    spark.dataSource.register(ArticleRows)
    options = {"path": path, "batchRows": str(batch_rows)}
    if symbol:
        options |= {"column": symbol[0], "equals": symbol[1]}
    if most is not None:
        options["maxRows"] = str(most)
    return spark.readStream.format("article_rows").schema(schema).options(**options).load()


def run_rows(stream: DataFrame, target: str, checkpoint: str, batches: int | None = None) -> None:
    """Append the stream's rows to Parquet until none is left, or for about ``batches`` batches; the checkpoint resumes."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).start()
    try:
        if batches is None:
            query.processAllAvailable()
        while batches is not None and query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < batches):
            query.awaitTermination(0.2)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
