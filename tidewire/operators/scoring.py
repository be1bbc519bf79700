"""Batch scoring of articles through a plug-in model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.session import give_back, short_batches

# A scorer turns a list of texts into (embeddings, logits), one row per text.
Scorer = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

SCORE_FIELDS = [
    T.StructField("finbert_embedding", T.ArrayType(T.FloatType())),
    T.StructField("sent_pos", T.DoubleType()),
    T.StructField("sent_neg", T.DoubleType()),
    T.StructField("sent_neu", T.DoubleType()),
]


def class_probabilities(logits: np.ndarray) -> np.ndarray:
    """Row-wise softmax."""
    weights = np.exp(logits - logits.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def score_articles(
    articles: DataFrame,
    scorer_factory: Callable[[], Scorer],
    text: str = "Article_title",
    batch_size: int = 128,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add embedding and class probabilities (positive, negative, neutral) to each article.

    ``scorer_factory`` is called once per task, where it loads the model; texts go
    to it whole, ``batch_size`` at a time, and a worker holds a short batch of rows at once.  A row without a text is not scored and has
    null results.  A row stays with its result, so nothing
    depends on row offsets.  Prune columns before, or name those to ``keep``.
    """
    short_batches(articles.sparkSession)
    rows = articles if keep is None else articles.select(*keep)
    schema = T.StructType(list(rows.schema.fields) + SCORE_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                known = part[text].notna().to_numpy()
                found = [None] * len(part)
                probabilities = np.full((len(part), 3), None, dtype=object)
                if known.any():
                    vectors, logits = scorer([str(t) for t in part[text][known]])
                    probabilities[known] = class_probabilities(np.asarray(logits, dtype=float))
                    for at, vector in zip(np.flatnonzero(known), np.asarray(vectors, dtype=np.float32)):
                        found[at] = vector
                part = part.assign(finbert_embedding=pd.Series(found, index=part.index, dtype=object))
                for i, name in enumerate(("sent_pos", "sent_neg", "sent_neu")):
                    part[name] = probabilities[:, i]
                yield part
        give_back()

    return rows.mapInPandas(run, schema)
