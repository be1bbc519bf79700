"""Conversion, stitching, saving and integrity of file sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.naming import chunk_number
from tidewire.functions.timefn import format_utc, parse_utc
from tidewire.sources import blocks, commit
from tidewire.sources.news import RAW_NEWS, read_csv


def readable_parquet(spark: SparkSession, path: str) -> bool:
    """True if all files of an existing Parquet folder have a footer; the footers are read in one parallel job.

    Only a missing folder and a file that is not Parquet are an answer; any other error, denied access for one, is raised.
    """
    if not commit.Store(spark, path).names(path):
        return False
    try:
        return len(spark.read.option("mergeSchema", True).parquet(path).columns) > 0
    except (PySparkException, Py4JJavaError) as error:
        if commit._is_format_error(error):
            return False
        raise


def conversion_state(spark: SparkSession, target: str) -> str:
    """The state of a published target. A folder without manifests is complete if its writer left ``_SUCCESS`` and all
    footers are whole, else unfinished."""
    found = commit.state(spark, target)
    if found == commit.UNFINISHED and any(n == "_SUCCESS" for n, _ in commit.Store(spark, target).names(target)):
        return commit.COMPLETE if readable_parquet(spark, target) else commit.BROKEN
    return found


def csv_to_parquet(
    spark: SparkSession,
    source: str | Sequence[str],
    target: str,
    schema: T.StructType = RAW_NEWS,
    date_col: str = "Date",
    multi_line: bool = True,
) -> bool:
    """Convert once: a complete target is kept (False); a missing, unfinished or broken one is made anew (True).

    The new version is switched to when it is whole, so readers never see half of one, and an error while the target
    is looked at stops the job. Parquet statistics stay on, since they drive row-group skipping.
    """
    if conversion_state(spark, target) == commit.COMPLETE:
        return False
    rows = read_csv(spark, source, schema, multi_line)
    commit.publish(rows.withColumn(date_col, parse_utc(date_col)), target)
    return True


def stitch(spark: SparkSession, paths: Sequence[str], target: str) -> DataFrame:
    """Many Parquet sets into one."""
    spark.read.parquet(*paths).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_chunks(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Chunk files with their number in ``chunk``; unreadable files are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", pattern)
    rows = reader.parquet(folder)
    return rows.select(chunk_number(F.col("_metadata.file_path")).alias("chunk"), "*")


def save(df: DataFrame, path: str, date_col: str = "date_utc") -> str:
    """Write by file ending; no ending means Parquet, an unknown one is refused.

    CSV gets the timestamp as text.  Returns the path written to.
    """
    name = path.rstrip("/").split("/")[-1]
    if name.lower().endswith(".csv"):
        out = df.withColumn(date_col, format_utc(date_col)) if date_col in df.columns else df
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif name.lower().endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif "." not in name:
        path += ".parquet"
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported ending: {name}; use .csv or .parquet")
    return path


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, batch_rows: int = 50_000
) -> DataFrame:
    """Apply ``fn`` to pieces of at most ``batch_rows`` rows, in parallel over the partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield fn(batch.iloc[start : start + batch_rows])

    return df.mapInPandas(run, schema)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of each file below ``path``; see ``blocks``."""
    return blocks.file_digests(spark, path, pattern)
