"""Components of wide sparse vectors against the full decomposition."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidewire.operators import reduction, subspace


def sparse_rows(n, width, seed):
    """Rows of few cells over a few topics, so that the leading variances differ."""
    rng = np.random.default_rng(seed)
    topics = rng.random((8, width)) ** 12
    rows = np.zeros((n, width))
    for i in range(n):
        weight = topics[rng.integers(8)] * (0.2 + rng.random())
        cells = rng.choice(width, 40, replace=False, p=weight / weight.sum())
        rows[i, cells] = rng.random(40)
    return rows


@pytest.mark.parametrize("width, k", [(200, 20), (1200, 12)])
def test_equals_full_decomposition(spark, monkeypatch, width, k):
    rows = sparse_rows(150, width, 3)
    made = [(i, Vectors.sparse(width, np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, r in enumerate(rows)]
    df = spark.createDataFrame(made, ["trading_session_date_utc", "tfidf"]).repartition(4)
    centred = rows - rows.mean(axis=0)
    _, values, right = np.linalg.svd(centred, full_matrices=False)
    monkeypatch.setattr(reduction, "SQUARE_WIDTH", 100)
    fitted = reduction.fit_pca(df, "tfidf", k)
    share = values**2 / (values**2).sum()
    assert np.allclose(fitted.explained_variance, share[:k], rtol=1e-5)
    assert np.allclose(np.abs(fitted.components.T @ right[:k].T).max(axis=1), 1.0, atol=1e-3)
    out = fitted.transform(df, "tfidf", "pc").orderBy("trading_session_date_utc").toPandas()
    got = out[[f"pc_{i}" for i in range(k)]].to_numpy()
    want = centred @ right[:k].T

    def distances(x):
        return np.linalg.norm(x[:, None, :] - x[None, :, :], axis=2)

    assert np.abs(distances(got) - distances(want)).max() < 1e-4
    assert (np.abs(fitted.components).argmax(axis=0) >= 0).all() and (fitted.components[np.abs(fitted.components).argmax(axis=0), range(k)] > 0).all()


def test_few_rows_zero_rows_and_limits(spark, monkeypatch):
    monkeypatch.setattr(reduction, "SQUARE_WIDTH", 3)
    rows = [(1, Vectors.sparse(6, [0, 2], [1.0, 2.0])), (2, Vectors.sparse(6, [], [])), (3, Vectors.dense([0, 0, 1.0, 0, 0, 5.0]))]
    df = spark.createDataFrame(rows, ["trading_session_date_utc", "tfidf"])
    fitted = reduction.fit_pca(df, "tfidf", 10)
    assert fitted.components.shape == (6, 3) and abs(fitted.explained_variance.sum() - 1) < 1e-9
    same = spark.createDataFrame([(1, Vectors.dense([1.0] * 6))] * 3, ["trading_session_date_utc", "tfidf"])
    assert np.allclose(reduction.fit_pca(same, "tfidf", 2).explained_variance, 0)
    monkeypatch.setattr(subspace, "MOST_CELLS", 10)
    with pytest.raises(ValueError):
        reduction.fit_pca(df, "tfidf", 2)
