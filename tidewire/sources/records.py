"""CSV records with line breaks inside quoted fields, read by many tasks per file.

A line break ends a record only outside quotes, that is, after an even number of quotes since the file began. One pass counts
the quotes of every byte range that Spark's scan makes of a file; their running sum says for each range whether it begins
inside quotes. In the second pass each range finds its records on its own, and the pieces that lie across ranges, at most two
for each, are put together. Text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import materialise

#: Ranges up to which their table is broadcast: a path, an offset and a bit each.
BROADCAST_RANGES = 500_000
QUOTE = '"'

# What a row of the second pass is: a whole record, or the piece of one that ends, begins or neither ends nor begins here.
WHOLE, ENDS, BEGINS, INSIDE = range(4)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as they stand in the files, with the file and the first byte of the range each was read from."""
    rows = spark.read.text(path if isinstance(path, str) else list(path), lineSep="\n")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def quote_ranges(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``range``, ``inside`` (it begins inside quotes) and ``paired`` (the file's quotes come in pairs); one row a range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counts = _lines(spark, path).groupBy("file", "range").agg(F.sum(quotes).alias("quotes"))
    file = Window.partitionBy("file")
    before = F.coalesce(F.sum("quotes").over(file.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("inside", before % 2 == 1).withColumn("paired", F.sum("quotes").over(file) % 2 == 0)
    return materialise(counts.drop("quotes"), "quote-ranges")


def _split(values: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line begins and whether it ends inside quotes."""
    odd = pc.fill_null(pc.count_substring(values, QUOTE), 0).to_numpy(zero_copy_only=False) & 1
    after = ((int(inside) + np.cumsum(odd)) & 1).astype(bool)
    return np.concatenate(([inside], after[:-1])), after


_PIECE = "file string, range bigint, kind int, first boolean, record string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records and pieces of the ranges of a task; lines of a range follow each other."""
    key, inside, at_begin, held, seen = None, False, False, [], False
    schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)

    def left_open() -> list[tuple]:
        kind = INSIDE if at_begin else BEGINS
        return [(*key, kind, first_open, "\n".join(held))] if held else []

    first_open = False
    for found in batches:
        if not found.num_rows:
            continue
        files, starts = found.column(0).to_pylist(), found.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(starts)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), len(starts)]
        rows: list[tuple] = []
        for low, high in zip(cuts, cuts[1:]):
            if (files[low], starts[low]) != key:
                rows += left_open() if key else []
                key, inside, held, seen = (files[low], starts[low]), found.column(3)[low].as_py(), [], False
                at_begin = inside
            values = found.column(2).slice(low, high - low)
            begins, ends = _split(values, inside)
            inside = bool(ends[-1])
            texts = values.to_pylist()
            for i in range(high - low):
                if not begins[i] and not ends[i]:
                    rows.append((*key, WHOLE, not seen and key[1] == 0, texts[i]))
                else:
                    if not begins[i]:
                        held, at_begin, first_open = [], False, not seen and key[1] == 0
                    held.append(texts[i])
                    if begins[i] and not ends[i]:
                        rows.append((*key, ENDS if at_begin else WHOLE, False if at_begin else first_open, "\n".join(held)))
                        held, at_begin = [], False
                seen = True
        if rows:
            yield batch(rows)
    if key and (rows := left_open()):
        yield batch(rows)


def records(spark: SparkSession, path: str | Sequence[str], ranges: DataFrame | None = None) -> DataFrame:
    """``file``, ``first`` (the file's first record) and ``record`` for the files whose quotes are paired; empty records are left out.

    Lines of a range must reach one task in their order. A broadcast keeps it; beyond ``BROADCAST_RANGES`` ranges the
    lines are numbered, joined and sorted again, which shuffles the text.
    """
    ranges = quote_ranges(spark, path) if ranges is None else ranges
    where = ranges.where("paired").select("file", "range", "inside")
    lines = _lines(spark, path)
    if ranges.count() <= BROADCAST_RANGES:
        placed = lines.join(F.broadcast(where), ["file", "range"])
    else:
        placed = lines.withColumn("line", F.monotonically_increasing_id()).join(where, ["file", "range"])
        placed = placed.repartition("file", "range").sortWithinPartitions("file", "range", "line")
    cut = placed.select("file", "range", "value", "inside").mapInArrow(_cut, _PIECE)
    whole = cut.where(F.col("kind") == WHOLE).select("file", "first", "record")
    pieces = materialise(cut.where(F.col("kind") != WHOLE), "record-pieces")
    # in a range the piece that ends comes before the one that begins
    order = Window.partitionBy("file").orderBy("range", F.col("kind") == BEGINS)
    chained = pieces.withColumn("chain", F.sum((F.col("kind") == BEGINS).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("range", "record")))
    joined = chained.groupBy("file", "chain").agg(F.max("first").alias("first"), F.array_join(parts["record"], "\n").alias("record"))
    both = whole.unionByName(joined.select("file", "first", "record"))
    return both.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def parse_records(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of ``record``; a field that does not fit its type is null."""
    options = {"quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "multiLine": "true"}
    if "_corrupt_record" in schema.names:
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
    return found.select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
