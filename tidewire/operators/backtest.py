"""Growth of one unit held by the strategy and by the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_future_return(master: DataFrame) -> DataFrame:
    """The next row's return inside each ticker; 0 on its last day."""
    line = Window.partitionBy("ticker").orderBy("trading_date")
    future = F.coalesce(F.lead("return_lag0").over(line), F.lit(0.0))
    return master.withColumn("future_return", future)


def strategy_returns(test: DataFrame, alignment: str = "next_day") -> DataFrame:
    """``market_return`` and ``strategy_return`` = prediction times return.

    ``next_day`` uses the return after the prediction and drops the last day of each
    ticker, which has none; ``same_day`` uses the return of the day itself (it looks
    ahead and is kept for comparison only).
    """
    if alignment == "same_day":
        rows, market = test, F.col("return_lag0")
    elif alignment == "next_day":
        line = Window.partitionBy("ticker").orderBy("trading_date")
        rows = test.withColumn("_more", F.lead("trading_date").over(line).isNotNull())
        rows, market = rows.where("_more"), F.col("future_return")
    else:
        raise ValueError(f"unknown alignment: {alignment}")
    return rows.select(
        "ticker",
        "trading_date",
        market.alias("market_return"),
        (F.col("prediction") * market).alias("strategy_return"),
    )


def growth(returns: DataFrame) -> DataFrame:
    """Running product of 1 + r per ticker, with a leading 1.0 at step 0.

    A ticker has one row per trading day, which bounds its window.
    """
    line = Window.partitionBy("ticker").orderBy("trading_date")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curves = returns.select(
        "ticker",
        F.row_number().over(line).cast("long").alias("step"),
        F.product(1 + F.col("strategy_return")).over(upto).alias("strategy"),
        F.product(1 + F.col("market_return")).over(upto).alias("market"),
    )
    start = returns.select("ticker").distinct().select(
        "ticker", F.lit(0).cast("long").alias("step"), F.lit(1.0).alias("strategy"), F.lit(1.0).alias("market")
    )
    return start.unionByName(curves)


def backtest(test: DataFrame, alignment: str = "next_day") -> DataFrame:
    """Growth curves of a test slice with ``prediction`` and returns."""
    return growth(strategy_returns(test, alignment))


def pooled_growth(returns: DataFrame) -> DataFrame:
    """One curve over all tickers in date order, as a single account trading each row in turn.

    The rows of a date are multiplied first, so the ordered window has one row per date.
    """
    per_date = returns.groupBy("trading_date").agg(
        F.product(1 + F.col("strategy_return")).alias("s"), F.product(1 + F.col("market_return")).alias("m")
    )
    upto = Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_date.select(
        "trading_date", F.product("s").over(upto).alias("strategy"), F.product("m").over(upto).alias("market")
    )
