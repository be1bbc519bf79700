"""Scaling with statistics of the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stats(train: DataFrame, columns: Sequence[str], deviation) -> Column:
    """All means and deviations in one aggregation, as one scalar subquery."""
    cells = []
    for i, c in enumerate(columns):
        cells += [F.avg(c).alias(f"m{i}"), deviation(c).alias(f"s{i}")]
    return train.agg(F.struct(*cells).alias("stats")).scalar()


def zscore(df: DataFrame, train: DataFrame, columns: Sequence[str], epsilon: float = 1e-7) -> DataFrame:
    """Sample deviation plus a small constant, as used for the neural models."""
    out = df.withColumn("_stats", _stats(train, columns, F.stddev_samp))
    scaled = {
        c: (F.col(c) - F.col(f"_stats.m{i}")) / (F.col(f"_stats.s{i}") + epsilon) for i, c in enumerate(columns)
    }
    return out.withColumns(scaled).drop("_stats")


def standardise(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population deviation; a constant column is only centred."""
    out = df.withColumn("_stats", _stats(train, columns, F.stddev_pop))
    scaled = {}
    for i, c in enumerate(columns):
        spread = F.col(f"_stats.s{i}")
        scaled[c] = (F.col(c) - F.col(f"_stats.m{i}")) / F.when(spread == 0, 1.0).otherwise(spread)
    return out.withColumns(scaled).drop("_stats")


class PopulationScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Vector scaler with population deviation, for use inside a pipeline.

    The built-in scaler divides by the sample deviation; one constant factor turns
    that into the population deviation.  A constant feature becomes 0.
    """

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        middle = f"_{self.uid}"
        scaler = StandardScaler(withMean=True, withStd=True, inputCol=self.getInputCol(), outputCol=middle)
        centred = scaler.fit(dataset)
        rows = dataset.count()
        factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
        stretch = ElementwiseProduct(
            scalingVec=Vectors.dense([factor] * centred.mean.size), inputCol=middle, outputCol=self.getOutputCol()
        )
        return PipelineModel([centred, stretch])
