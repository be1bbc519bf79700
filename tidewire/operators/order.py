"""Positions and running totals that never put all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import materialise


def with_row_id(df: DataFrame, key: Sequence[str], name: str = "id") -> DataFrame:
    """Zero-based position under a declared total order.

    The rows are range-partitioned by the key, so no task sees more than its
    slice.  The slices are written once: numbers and rows must come from the same
    ones, also after an executor is lost.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    slices = df.repartitionByRange(parts, *key).withColumn("_slice", F.spark_partition_id())
    slices = materialise(slices, "row-id")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = slices.groupBy("_slice").count()  # one row per slice
    starts = sizes.select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    numbered = slices.withColumn("_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(*key)))
    numbered = numbered.join(F.broadcast(starts), "_slice")
    return numbered.select((F.col("_start") + F.col("_rank") - 1).alias(name), *df.columns)


def date_positions(df: DataFrame, date: str) -> DataFrame:
    """Rows per date with the number of rows on earlier dates (``first``) and in all (``n``).

    Holds one row per calendar date (timestamps are refused), so the ordered window
    stays small however many rows the dates have.
    """
    if not isinstance(df.schema[date].dataType, T.DateType):
        raise ValueError(f"{date} is not a date column")
    per_date = df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_date.select(
        date,
        "rows",
        (F.sum("rows").over(upto) - F.col("rows")).alias("first"),
        F.sum("rows").over(whole).alias("n"),
    )


def with_position(df: DataFrame, date: str, tie: str, name: str = "position") -> DataFrame:
    """Zero-based position in ``(date, tie)`` order, ``(date, tie)`` being unique.

    Date totals give the offset, and only the rows of one date are ranked together:
    at most one row per ticker.
    """
    starts = date_positions(df, date).select(date, F.col("first").alias("_first"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(date).orderBy(tie)))
    joined = ranked.join(starts, date)
    return joined.select(*df.columns, (F.col("_first") + F.col("_rank") - 1).alias(name))


def running_totals(
    df: DataFrame, key: str, values: Sequence[str], cells: tuple[Column, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<value>_before``: the sum over all rows of the same ``by`` with a smaller ``key``.

    ``(by, key)`` is unique.  ``cells`` are a coarse and a fine column that grow with the
    key; the totals run over coarse cells, then over the fine cells of a coarse
    one, then over the keys of a fine one, so no window spans the whole table.
    """
    c1, c2 = "_coarse", "_fine"
    rows = df.withColumn(c1, cells[0]).withColumn(c2, cells[1])
    fine = rows.groupBy(*by, c1, c2).agg(*[F.sum(v).alias(v) for v in values])
    coarse = fine.groupBy(*by, c1).agg(*[F.sum(v).alias(v) for v in values])

    def before(group: Sequence[str], order: str, level: int) -> list[Column]:
        window = Window.partitionBy(*by, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(v).over(window), F.lit(0)).alias(f"_{level}{v}") for v in values]

    coarse = coarse.select(*by, c1, *before([], c1, 1))
    fine = fine.select(*by, c1, c2, *before([c1], c2, 2))
    rows = rows.select("*", *before([c1, c2], key, 3))
    joined = rows.join(fine, [*by, c1, c2]).join(coarse, [*by, c1])
    sums = [(F.col(f"_1{v}") + F.col(f"_2{v}") + F.col(f"_3{v}")).alias(f"{v}_before") for v in values]
    return joined.select(*df.columns, *sums)


def score_cells(score: str) -> tuple[Column, Column]:
    """Coarse and fine cells for scores; made for probabilities, right for any finite number."""
    scaled = F.col(score) * F.lit(65536.0)
    limit = F.lit(float(1 << 20))
    coarse = F.floor(F.greatest(F.least(scaled, limit), -limit))
    fine = F.floor(F.greatest(F.least((scaled - coarse) * F.lit(65536.0), F.lit(65536.0)), F.lit(-1.0)))
    return coarse, fine
