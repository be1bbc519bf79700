"""Joining daily features to the price timeline, and choosing feature sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.prices import PRICE_FEATURES, standardise_date

# Feature groups of each mode.
CLASSIC_MODES = {
    "price": ("price",),
    "tfidf": ("tfidf",),
    "finbert": ("finbert",),
    "hybrid_tfidf": ("price", "tfidf"),
    "hybrid_finbert": ("price", "finbert"),
}
NEURAL_MODES = {
    "price": ("price",),
    "tfidf": ("tfidf",),
    "finbert_sent": ("finbert_sent",),
    "finbert_emb": ("finbert_emb",),
    "tfidf_hybrid": ("price", "tfidf"),
    "finbert_sent_hybrid": ("price", "finbert_sent"),
    "finbert_emb_hybrid": ("price", "finbert_emb"),
}


def join_features(master: DataFrame, features: DataFrame, date: str | None = None) -> DataFrame:
    """Left join of one feature row per day onto every ticker of that day; no news means 0.

    Only the numeric feature columns are filled.  Both sides have at most one row per
    day and ticker; the join strategy is left to the sizes Spark measures at run time.
    """
    date = date or next(c for c in ("trading_date", "trading_session_date_utc", "date") if c in features.columns)
    features = standardise_date(features, date)
    numeric = [
        f.name for f in features.schema if f.name != "trading_date" and isinstance(f.dataType, T.NumericType)
    ]
    return master.join(features, "trading_date", "left").fillna(0, subset=numeric)


def feature_names(features: DataFrame) -> list[str]:
    """Everything but the date is a feature."""
    dates = {"trading_date", "trading_session_date_utc", "date"}
    return [c for c in features.columns if c not in dates]


def reorder(master: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Date, label, ticker, price, sentiment, terms; columns that are absent are skipped."""
    ideal = ["trading_date", "target_next_day", "ticker"]
    for name in ("price", "finbert", "finbert_sent", "finbert_emb", "tfidf"):
        ideal += groups.get(name, [])
    return master.select(*[f"`{c}`" for c in dict.fromkeys(ideal) if c in master.columns])


def date_first(df: DataFrame, column: str) -> DataFrame:
    return df.select(column, *[c for c in df.columns if c != column])


def feature_columns(
    mode: str,
    groups: Mapping[str, Sequence[str]],
    available: Sequence[str] | None = None,
    modes: Mapping[str, Sequence[str]] = CLASSIC_MODES,
    sequences: bool = False,
) -> list[str]:
    """Columns of a mode; unknown modes, empty sets and missing columns are errors.

    For sequences the price part is the current return alone, since the window
    itself holds the history.
    """
    if mode not in modes:
        raise ValueError(f"invalid mode: {mode}")
    chosen: list[str] = []
    for group in modes[mode]:
        if group == "price" and sequences:
            chosen += ["return_lag0"]
        else:
            chosen += groups.get(group, PRICE_FEATURES if group == "price" else [])
    if not chosen:
        raise ValueError(f"no features for mode {mode}")
    missing = [c for c in chosen if available is not None and c not in available]
    if missing:
        raise ValueError(f"missing columns for mode {mode}: {missing[:5]}")
    return chosen


def assemble(
    master: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("trading_date", "ticker"),
    label: str = "target_next_day",
) -> DataFrame:
    """Keys, integer label and the feature vector."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(master).select(*keep, F.col(label).cast("int").alias("label"), "features")
