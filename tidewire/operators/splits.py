"""Time splits by position in ``(date, tie)`` order, without moving the rows.

A split is a few boundary rows: the rows found at given positions.  They come from
the row counts per date and a ranking inside the boundary dates alone; every other
row is then compared with them where it lies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.order import date_positions


def cutoff_date(df: DataFrame, date: str, ratio: float = 0.7) -> Column:
    """The date found at position ``int(n * ratio)`` in date order, as a scalar subquery.

    Needs only the row count of each date, not a sort of the rows.
    """
    at = F.floor(F.col("n") * F.lit(ratio))
    spans = date_positions(df, date)
    hit = spans.where((F.col("first") <= at) & (at < F.col("first") + F.col("rows")))
    return hit.select(date).scalar()


def row_count_split(df: DataFrame, date: str, ratio: float = 0.7, name: str = "split") -> DataFrame:
    """``train`` before the cutoff date, ``test`` from it on; rows without a date are in neither."""
    cut = cutoff_date(df, date, ratio)
    side = F.when(F.col(date) < cut, "train").when(F.col(date) >= cut, "test")
    return df.withColumn(name, side)


def total_rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def boundary_rows(keys: DataFrame, date: str, tie: str, positions: Callable[[Column], list[Column]]) -> Column:
    """The ``(date, tie)`` keys at the given positions, sorted, as one scalar subquery.

    ``positions`` maps the number of rows to zero-based positions; those past the end
    give no key.
    """
    asked = F.posexplode(F.array(*positions(F.col("n")))).alias("slot", "at")
    spans = date_positions(keys, date).select("*", asked)
    hits = spans.where((F.col("first") <= F.col("at")) & (F.col("at") < F.col("first") + F.col("rows")))
    hits = hits.select(date, "slot", (F.col("at") - F.col("first")).alias("offset"))
    # as many rows as positions asked for
    near = keys.select(date, tie).join(F.broadcast(hits), date)
    rank = F.row_number().over(Window.partitionBy(date, "slot").orderBy(tie)) - 1
    found = near.withColumn("rank", rank).where("rank = offset")
    return found.agg(F.array_sort(F.collect_list(F.struct(date, tie))).alias("keys")).scalar()


def _as_literal(edges: Column, df: DataFrame, date: str, tie: str) -> Column:
    """Run the subquery now and give its few keys as a literal."""
    found = df.sparkSession.range(1).select(edges.alias("keys")).first()["keys"] or []
    kinds = {c: df.schema[c].dataType for c in (date, tie)}
    key_type = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])
    cells = [F.struct(*[F.lit(k[c]).cast(kind).alias(c) for c, kind in kinds.items()]) for k in found]
    return F.array(*cells).cast(T.ArrayType(key_type))


def with_block(
    df: DataFrame,
    date: str,
    tie: str,
    positions: Callable[[Column], list[Column]],
    name: str = "block",
    align_dates: bool = False,
    eager: bool = False,
) -> DataFrame:
    """Number of boundary positions at or before each row.

    With ``align_dates`` a boundary takes its whole date along.  With ``eager`` the
    boundaries are found at once; use it if many jobs will read the result.
    """
    edges = boundary_rows(df, date, tie, positions)
    if eager:
        edges = _as_literal(edges, df, date, tie)
    marked = df.withColumn("_edges", edges)
    key = F.struct(date, tie)

    def passed(edge: Column) -> Column:
        return edge[date] <= F.col(date) if align_dates else edge <= key

    return marked.withColumn(name, F.size(F.filter("_edges", passed))).drop("_edges")


def tail_split(
    df: DataFrame,
    date: str,
    tie: str,
    test_size: float = 0.3,
    align_dates: bool = False,
    name: str = "split",
    eager: bool = False,
) -> DataFrame:
    """The last ``ceil(n * test_size)`` rows are ``test``, the others ``train``.

    With ``align_dates`` no date is cut in two: the boundary date goes to ``test``.
    """
    blocks = with_block(
        df, date, tie, lambda n: [n - F.ceil(n * F.lit(test_size))], "_block", align_dates, eager
    )
    return blocks.withColumn(name, F.when(F.col("_block") > 0, "test").otherwise("train")).drop("_block")


def three_way_split(
    df: DataFrame,
    date: str,
    tie: str,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    name: str = "split",
    eager: bool = False,
) -> DataFrame:
    """``int(n * train)`` rows, ``int(n * val)`` rows, and the rest."""

    def positions(n: Column) -> list[Column]:
        first = F.floor(n * F.lit(train_ratio))
        return [first, first + F.floor(n * F.lit(val_ratio))]

    blocks = with_block(df, date, tie, positions, "_block", eager=eager)
    block = F.col("_block")
    side = F.when(block == 0, "train").when(block == 1, "val").otherwise("test")
    return blocks.withColumn(name, side).drop("_block")


def fold_blocks(
    df: DataFrame, date: str, tie: str, k: int = 5, name: str = "block", eager: bool = False
) -> DataFrame:
    """The fold each row is tested in, 1 to k; 0 for the rows only ever trained on.

    The test blocks are the last k blocks of ``n // (k + 1)`` rows.  Fold f trains on all
    blocks below f, so the rows need not be copied per fold.
    """

    def positions(n: Column) -> list[Column]:
        size = F.floor(n / F.lit(k + 1))
        return [n - size * F.lit(k - i) for i in range(k)]

    return with_block(df, date, tie, positions, name, eager=eager)


def expanding_folds(
    df: DataFrame, date: str, tie: str, k: int = 5, eager: bool = False
) -> DataFrame:
    """Every row once per fold it takes part in, as ``fold`` (1 to k) and ``role``."""
    placed = fold_blocks(df, date, tie, k, "_block", eager)
    first_fold = F.greatest(F.col("_block"), F.lit(1))
    rows = placed.withColumn("fold", F.explode(F.sequence(first_fold, F.lit(k))))
    role = F.when(F.col("fold") == F.col("_block"), "test").otherwise("train")
    return rows.withColumn("role", role).drop("_block")


def last_fold(df: DataFrame, date: str, tie: str, k: int = 5, eager: bool = False) -> DataFrame:
    """The newest fold only."""
    placed = fold_blocks(df, date, tie, k, "_block", eager)
    rows = placed.withColumn("fold", F.lit(k))
    return rows.withColumn("role", F.when(F.col("_block") == k, "test").otherwise("train")).drop("_block")
