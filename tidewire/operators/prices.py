"""Returns, labels and lags per ticker.

A ticker has one row per trading day, so its window holds at most about 250 rows
a year, however many tickers and articles there are.  ``one_per_day`` enforces that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.timefn import parse_date
from tidewire.sources.news import between_if_both

LAGS = 5
PRICE_FEATURES = [f"return_lag{i}" for i in range(LAGS + 1)]


def standardise_date(df: DataFrame, current: str, name: str = "trading_date") -> DataFrame:
    """Rename the date column to the master key and parse it if it is text."""
    is_text = df.schema[current].dataType.typeName() == "string"
    if current != name:
        df = df.withColumnRenamed(current, name)
    return df.withColumn(name, parse_date(name)) if is_text else df


def date_column(df: DataFrame) -> str:
    """The session column if present, else ``date``."""
    return "trading_session_date_utc" if "trading_session_date_utc" in df.columns else "date"


def one_per_day(prices: DataFrame, ticker: str = "ticker", date: str = "trading_date") -> DataFrame:
    """One row per ticker and day; of several the one with the largest close."""
    rest = [c for c in prices.columns if c not in (ticker, date)]
    first = ["close"] if "close" in rest else []
    best = F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_row")
    picked = prices.groupBy(ticker, date).agg(best)
    return picked.select(*[c if c in (ticker, date) else F.col(f"_row.{c}").alias(c) for c in prices.columns])


def _by_ticker(ticker: str = "ticker", date: str = "trading_date"):
    return Window.partitionBy(ticker).orderBy(date)


def with_returns(prices: DataFrame) -> DataFrame:
    """``return_lag0``: change against the last known close.

    A missing close counts as unchanged, a zero close before gives null.
    """
    line = _by_ticker()
    known = F.last("close", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    filled = prices.withColumn("_close", known)
    change = F.try_divide(F.col("_close"), F.lag("_close").over(line)) - 1
    return filled.withColumn("return_lag0", change).drop("_close")


def with_label(returns: DataFrame) -> DataFrame:
    """``target_next_day``: 1 if the next return is positive, 0 if not, null on the last day."""
    following = F.lead("return_lag0").over(_by_ticker())
    return returns.withColumn("target_next_day", (following > 0).cast("byte"))


def with_lags(returns: DataFrame, lags: int = LAGS) -> DataFrame:
    line = _by_ticker()
    return returns.withColumns({f"return_lag{i}": F.lag("return_lag0", i).over(line) for i in range(1, lags + 1)})


def price_timeline(prices: DataFrame, start=None, end=None, lags: int = LAGS) -> DataFrame:
    """The master timeline of all tickers at once.

    The date range is applied first, and only if both ends are given; rows without
    a full history or a next day drop out.
    """
    rows = between_if_both(standardise_date(prices, "date"), "trading_date", start, end)
    if "ticker" not in rows.columns:
        rows = rows.withColumn("ticker", F.lit("all"))
    rows = with_lags(with_label(with_returns(rows.select("ticker", "trading_date", "close"))), lags)
    names = [f"return_lag{i}" for i in range(lags + 1)]
    return rows.select("trading_date", "ticker", "target_next_day", *names).dropna()


def up_down_days(prices: DataFrame) -> DataFrame:
    """Same-day label of the price-bar model: ``close`` above the row before it.

    Rows without a close, and those after one or at the start, drop out.
    """
    before = F.lag("close").over(_by_ticker())
    labelled = prices.withColumn("up_down", (F.col("close") > before).cast("byte"))
    return labelled.dropna(subset=["close", "up_down"])
