"""File streams of articles into Parquet, and restartable chunk jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.sources.news import only_symbol


def article_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None, pattern: str = "*.parquet"
) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, target: str, checkpoint: str, symbol: str | None = None) -> None:
    """Filter by symbol and append to ``target`` until the files at hand are done.

    The checkpoint makes each file count once, also after a restart.
    """
    rows = only_symbol(stream, symbol)
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The stop after ``n`` rows, as a limit under a declared order on the sink."""
    return df.orderBy(*order).limit(n)


def finished_chunks(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema("chunk long").parquet(ledger).distinct()
    except PySparkException:
        return spark.createDataFrame([], "chunk long")


def process_chunks(
    df: DataFrame,
    chunk: str,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    ledger: str,
) -> DataFrame:
    """Apply ``work`` to the chunks not in the ledger and add them to ``target``.

    All open chunks run as one distributed job and each chunk, of bounded size, goes
    into one file.  A chunk is a partition of the target and is overwritten as a whole, so
    a job lost half way leaves nothing behind that a second run would double; the ledger
    is written last.
    """
    spark = df.sparkSession
    finished = finished_chunks(spark, ledger).withColumnRenamed("chunk", chunk)
    open_rows = df.join(finished, chunk, "left_anti")
    result = work(open_rows)
    (
        result.repartition(chunk)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(chunk)
        .parquet(target)
    )
    done = open_rows.select(F.col(chunk).cast("long").alias("chunk")).distinct()
    done.write.mode("append").parquet(ledger)
    return spark.read.parquet(target)


def refuse_leftovers(spark: SparkSession, ledger: str) -> None:
    """Stop a fresh run if chunks of an earlier one are still there."""
    left = finished_chunks(spark, ledger).count()
    if left:
        raise FileExistsError(f"{left} finished chunks in {ledger}; resume or choose another folder")


def chunked(df: DataFrame, key: str, rows: int = 50_000, columns: Sequence[str] | None = None) -> DataFrame:
    """Number the chunks by a dense integer key, about ``rows`` rows each."""
    kept = df if columns is None else df.select(*columns)
    return kept.withColumn("chunk", F.floor(F.col(key) / F.lit(rows)))
