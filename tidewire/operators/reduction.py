"""Centred principal components with a fixed sign."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.sessions import SESSION
from tidewire.operators.subspace import leading_components
from tidewire.session import materialise


#: Vectors up to this width have their covariance matrix summed up (1 MB); wider ones are projected, see ``subspace``.
SQUARE_WIDTH = 384


@dataclass
class CentredPca:
    """Fitted components, one column each; the largest loading by magnitude is positive."""

    components: np.ndarray
    mean: np.ndarray
    explained_variance: np.ndarray

    def transform(self, df: DataFrame, column: str, prefix: str) -> DataFrame:
        """Add one column per component, ``<prefix>_0`` and on: the centred vector's coordinates."""
        k = self.components.shape[1]
        offset = (self.mean @ self.components).tolist()
        model = _projection(self.components)
        projected = model.setInputCol(column).setOutputCol("_pc").transform(df)
        projected = projected.withColumn("_pc", vector_to_array("_pc"))
        named = {f"{prefix}_{i}": F.get("_pc", i) - F.lit(offset[i]) for i in range(k)}
        return projected.withColumns(named).drop("_pc")


def _projection(components: np.ndarray) -> PCAModel:
    """A JVM model that multiplies vectors, sparse ones too, by the components."""
    jvm = SparkSession.active()._jvm
    width, k = components.shape
    matrix = _py2java(SparkSession.active().sparkContext, DenseMatrix(width, k, components.ravel(order="F").tolist()))
    variances = _py2java(SparkSession.active().sparkContext, Vectors.dense([0.0] * k))
    model = PCAModel(jvm.org.apache.spark.ml.feature.PCAModel(f"pca-{uuid.uuid4().hex}", matrix, variances))
    return model._set(k=k)


def fit_pca(train: DataFrame, column: str, components: int) -> CentredPca:
    """Fit on the rows given; components are capped by rows and width.

    Narrow vectors have their covariance summed up over the cluster; only that matrix and the loadings reach
    the driver.  Wide ones are projected round by round, so no matrix of width times width exists anywhere.
    """
    row = train.select(Summarizer.metrics("mean", "count").summary(F.col(column)).alias("s")).first()["s"]
    mean = row["mean"].toArray()
    k = min(components, row["count"], len(mean))
    if len(mean) > SQUARE_WIDTH:
        mean, loadings, variance = leading_components(train, column, k)
    else:
        model = PCA(k=k, inputCol=column, outputCol="_pc").fit(train)
        loadings, variance = model.pc.toArray(), model.explainedVariance.toArray()
    top = np.abs(loadings).argmax(axis=0)
    signs = np.where(loadings[top, range(k)] < 0, -1.0, 1.0)
    return CentredPca(loadings * signs, mean, variance)


def reduce_days(
    daily: DataFrame,
    column: str,
    components: int,
    prefix: str,
    train: DataFrame | None = None,
    session: str = SESSION,
) -> DataFrame:
    """Daily vectors to ``<prefix>_i`` columns per session.

    ``train`` holds the sessions to fit on; without it all days are used, which lets
    later days shape the components.  The vectors, one per day, are written once since
    fitting reads them several times.
    """

    def as_vectors(df: DataFrame) -> DataFrame:
        if df.schema[column].dataType.typeName() == "array":
            return df.withColumn(column, array_to_vector(F.transform(column, lambda x: x.cast("double"))))
        return df

    vectors = materialise(as_vectors(daily), "daily-vectors")
    fit_rows = vectors if train is None else vectors.join(train.select(session), session, "left_semi")
    fitted = fit_pca(fit_rows, column, components)
    out = fitted.transform(vectors, column, prefix)
    return out.select(session, *[f"{prefix}_{i}" for i in range(fitted.components.shape[1])])
