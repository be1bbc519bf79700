"""Price scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.naming import ticker_of
from tidewire.functions.timefn import parse_date
from tidewire.sources.news import read_csv

PRICE_FILE = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")]
)


def read_prices(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ("date", "close")
) -> DataFrame:
    """All ticker files (or folders) in one scan; the ticker is the name before ``.csv``."""
    rows = read_csv(spark, path, PRICE_FILE, multi_line=False)
    wanted = [parse_date("date").alias("date") if c == "date" else F.col(c) for c in columns]
    return rows.select(*wanted, ticker_of(F.input_file_name()).alias("ticker"))


def first_days(prices: DataFrame, n: int, date: str = "date", ticker: str = "ticker") -> DataFrame:
    """The first ``n`` rows in time order (a row limit needs a declared order)."""
    return prices.orderBy(date, ticker).limit(n)
