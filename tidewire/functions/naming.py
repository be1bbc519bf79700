"""File names and parameter maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.timefn import as_column


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(as_column(path), "/"), -1)


def ticker_of(path: Column | str) -> Column:
    """``AAPL`` of ``prices/AAPL.csv`` or ``prices/ticker=AAPL.csv/part-0.csv``, URL escapes undone."""
    name = F.regexp_extract(as_column(path), r"([^/=]+)\.csv(?:/part-[^/]*)?$", 1)
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def chunk_number(path: Column | str) -> Column:
    """``backup_chunk_12.parquet`` gives 12; null if the name has no number."""
    return F.regexp_extract(file_name(path), r"_(\d+)\.[^.]*$", 1).try_cast("long")


def single_value_grid(params: dict) -> dict:
    """One parameter set as a grid with one value per name."""
    return {name: [value] for name, value in params.items()}
