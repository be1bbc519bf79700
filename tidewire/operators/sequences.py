"""Sliding windows over the days of each ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_windows(
    master: DataFrame, columns: Sequence[str], length: int = 5, label: str = "target_next_day"
) -> DataFrame:
    """Windows of ``length`` consecutive rows per ticker, with label and date of the last row.

    A ticker of n rows gives n - length + 1 windows; none mixes tickers.
    """
    line = Window.partitionBy("ticker").orderBy("trading_date").rowsBetween(-(length - 1), 0)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    windows = master.select(
        "trading_date", "ticker", F.collect_list(row).over(line).alias("window"), F.col(label).alias("target")
    )
    return windows.where(F.size("window") == length)


def flatten_windows(windows: DataFrame) -> DataFrame:
    """Each window as one flat array, oldest day first."""
    return windows.withColumn("window", F.flatten("window"))


def window_rows(windows: DataFrame) -> DataFrame:
    """Windows as model input: keys, integer label, one flat vector."""
    flat = flatten_windows(windows)
    return flat.select(
        "trading_date", "ticker", F.col("target").cast("int").alias("label"), array_to_vector("window").alias("features")
    )


def window_stats(windows: DataFrame) -> DataFrame:
    """Mean and sample deviation per feature over all cells of the given windows.

    A row counts once per window that holds it.
    """
    steps = windows.select(F.explode("window").alias("step"))
    cells = steps.select(F.posexplode("step").alias("feature", "value"))
    return cells.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def scale_windows(windows: DataFrame, stats: DataFrame, epsilon: float = 1e-7) -> DataFrame:
    """Scale every cell with the statistics of its feature (one row per feature)."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", "mean", "std")))
    packed = stats.agg(ordered.alias("s")).scalar()

    def scale_step(step):
        return F.zip_with(step, F.col("_stats"), lambda x, s: (x - s["mean"]) / (s["std"] + epsilon))

    scaled = windows.withColumn("_stats", packed)
    return scaled.withColumn("window", F.transform("window", scale_step)).drop("_stats")
