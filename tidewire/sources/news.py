"""News scans and their filters."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.naming import file_name
from tidewire.functions.text import without_script
from tidewire.functions.timefn import attach_utc, parse_utc, to_zone
from tidewire.sources import commit
from tidewire.sources.records import parse_records, quote_ranges, records

RAW_NEWS = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Article_title", T.StringType()),
        T.StructField("Stock_symbol", T.StringType()),
    ]
)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = RAW_NEWS,
    multi_line: bool = True,
    keep_bad_rows: bool = False,
) -> DataFrame:
    """CSV with a header; bad fields become null instead of failing the job.

    Columns are matched to the header by name, so more or reordered columns work; all
    files of one call must share a header, others are refused.  ``multi_line`` allows line breaks inside quoted text;
    such files are read by many tasks each (see ``records``), but for those whose quotes do not come in pairs, which
    are one task each.  Without it no second pass over the bytes is needed.
    With ``keep_bad_rows`` the raw text of a malformed row is kept in
    ``_corrupt_record``.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"'}
    options.update({"mode": "PERMISSIVE", "enforceSchema": False})
    header = spark.read.options(**options).csv(path).columns
    by_name = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(n, by_name.get(n, T.StringType())) for n in header])
    if keep_bad_rows:
        full.add("_corrupt_record", T.StringType())
    kept = [F.col(f"`{n}`") for n in full.names if n in by_name or n == "_corrupt_record"]
    if not multi_line:
        return spark.read.options(**options).schema(full).csv(path).select(*kept)
    ranges = quote_ranges(spark, path)
    rows = _from_ranges(spark, path, ranges, header, full).select(*kept)
    unpaired = [r["file"] for r in ranges.where("not paired").select("file").distinct().collect()]  # names of broken files
    if unpaired:
        rows = rows.unionByName(spark.read.options(**options).schema(full).csv(unpaired).select(*kept))
    return rows


def _from_ranges(spark: SparkSession, path: str | Sequence[str], ranges: DataFrame, header: list[str], schema: T.StructType) -> DataFrame:
    found = records(spark, path, ranges)
    names = T.StructType([T.StructField(n, T.StringType()) for n in header])
    firsts = found.where("first").select(F.regexp_replace("record", "^\ufeff", "").alias("record")).distinct().limit(2)
    headers = [list(r) for r in parse_records(firsts, names).collect()]
    if any(h != header for h in headers):
        raise ValueError(f"files of one call have different headers: {headers}")
    return parse_records(found.where("not first"), schema)


def _with_dates(df: DataFrame, date_col: str, from_text: bool) -> DataFrame:
    stamp = parse_utc(date_col) if from_text else attach_utc(date_col)
    df = df.withColumn(date_col, stamp).withColumnRenamed(date_col, "date_utc")
    return df.select(to_zone("date_utc").alias("date_est"), *df.columns)


def read_news(
    spark: SparkSession,
    path: str | Sequence[str],
    date_col: str = "Date",
    schema: T.StructType = RAW_NEWS,
    multi_line: bool = True,
) -> DataFrame:
    """News from CSV, Parquet or published tables with ``date_est`` first and the date as ``date_utc``."""
    first = path if isinstance(path, str) else path[0]
    if first.lower().rstrip("/").endswith(".csv"):
        return _with_dates(read_csv(spark, path, schema, multi_line), date_col, from_text=True)
    paths = [path] if isinstance(path, str) else list(path)
    published = [commit.manifest(spark, p) is not None for p in paths]
    parts = [commit.read_published(spark, p) for p, done in zip(paths, published) if done]
    plain = [p for p, done in zip(paths, published) if not done]
    raw = functools.reduce(DataFrame.unionByName, parts + ([spark.read.parquet(*plain)] if plain else []))
    return _with_dates(raw, date_col, from_text=isinstance(raw.schema[date_col].dataType, T.StringType))


def only_symbol(df: DataFrame, symbol: str | None, column: str = "Stock_symbol") -> DataFrame:
    return df if symbol is None else df.where(F.col(column) == symbol)


def _bound(value, kind: T.DataType):
    """A literal in UTC, whatever the session time zone; zoned datetimes are converted."""
    if isinstance(value, datetime):
        value = value.astimezone(timezone.utc) if value.tzinfo else value
        value = value.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(value).cast(kind)


def in_range(df: DataFrame, column: str, start=None, end=None, closed: str = "both") -> DataFrame:
    """Keep ``start <= column <= end`` (or ``< end`` for ``closed='left'``); open ends allowed.

    Bounds are literals of the column's own type, so they reach the Parquet scan.
    """
    kind = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= _bound(start, kind))
    if end is not None:
        bound = _bound(end, kind)
        df = df.where(F.col(column) <= bound if closed == "both" else F.col(column) < bound)
    return df


def between_if_both(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive range, applied only if both ends are given."""
    return df if start is None or end is None else in_range(df, column, start, end)


def load_news(
    spark: SparkSession,
    path: str | Sequence[str],
    start=None,
    end=None,
    symbol: str | None = None,
    text_col: str = "Article_title",
    filter_russian: bool = False,
    date_col: str = "Date",
    schema: T.StructType = RAW_NEWS,
    multi_line: bool = True,
) -> DataFrame:
    """Scan and filter in one plan; ``schema`` and ``multi_line`` are those of ``read_csv``."""
    df = only_symbol(read_news(spark, path, date_col, schema, multi_line), symbol)
    df = in_range(df, "date_utc", start, end)
    return without_script(df, text_col) if filter_russian else df


def load_sources(
    spark: SparkSession, paths: Mapping[str, str], **options
) -> tuple[DataFrame | None, DataFrame]:
    """Several sources as one frame tagged with ``source_name``, and a load report.

    A path that cannot be opened is reported and left out; the others go on.
    """
    frames, report = [], []
    for name, path in paths.items():
        try:
            frames.append(load_news(spark, path, **options).withColumn("source_name", F.lit(name)))
            report.append((name, path, True, None))
        except (AnalysisException, ValueError) as error:
            report.append((name, path, False, str(error).splitlines()[0]))
    merged = None
    for frame in frames:
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    schema = "source_name string, path string, loaded boolean, message string"
    listed = spark.createDataFrame(report, schema).withColumn("file_name", file_name("path"))
    return merged, listed

