"""Components, TF-IDF and scores as pipeline stages that can be saved and loaded.

A saved run is replayed from its model, not fitted again: scaler, components and classifier are written with the pipeline.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import metrics, models
from tidewire.operators.reduction import CentredPca, fit_pca
from tidewire.operators.tfidf import TfidfModel
from tidewire.session import materialise

#: Cells of an array that go into one row of a saved model.
ROW_CELLS = 100_000


# -- components --------------------------------------------------------------------------------------------------
class _Components(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "components at most", TypeConverters.toInt)


class Components(Estimator, _Components, DefaultParamsReadable, DefaultParamsWritable):
    """Centred principal components of a vector column, as a vector column; wide sparse vectors too."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "components", k: int = 30):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="components", k=30)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ComponentsModel:
        rows = materialise(dataset.select(self.getInputCol()), "component-rows")  # read several times
        fitted = fit_pca(rows, self.getInputCol(), self.getOrDefault(self.k))
        return ComponentsModel(fitted, self.getInputCol(), self.getOutputCol())


class ComponentsModel(Model, MLWritable, MLReadable):
    def __init__(self, fitted: CentredPca | None = None, input_col: str = "features", output_col: str = "components"):
        super().__init__()
        self.fitted, self.input_col, self.output_col = fitted, input_col, output_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prefix = f"_{self.uid}"
        wide = self.fitted.transform(dataset, self.input_col, prefix)
        names = [f"{prefix}_{i}" for i in range(self.fitted.components.shape[1])]
        return wide.withColumn(self.output_col, array_to_vector(F.array(*names))).drop(*names)

    def copy(self, extra=None) -> ComponentsModel:
        return self

    def write(self) -> MLWriter:
        return _ComponentsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ComponentsReader()


def save_array(spark: SparkSession, values: np.ndarray, path: str) -> None:
    flat = values.ravel()
    rows = [(low, flat[low : low + ROW_CELLS].tolist()) for low in range(0, len(flat), ROW_CELLS)]
    spark.createDataFrame(rows, "at long, cells array<double>").write.parquet(path)


def load_array(spark: SparkSession, path: str, shape: list[int]) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("at").collect()  # a model's own numbers
    return np.array([c for r in rows for c in r["cells"]], float).reshape(shape)


class _ComponentsWriter(MLWriter):
    def __init__(self, model: ComponentsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, fitted = self.model, self.model.fitted
        extra = {"shape": list(fitted.components.shape), "variance": fitted.explained_variance.tolist(), "input": m.input_col, "output": m.output_col}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        save_array(self.sparkSession, fitted.components, f"{path}/components")
        save_array(self.sparkSession, fitted.mean, f"{path}/mean")


class _ComponentsReader(MLReader):
    def load(self, path: str) -> ComponentsModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        shape = found["shape"]
        fitted = CentredPca(
            load_array(self.sparkSession, f"{path}/components", shape), load_array(self.sparkSession, f"{path}/mean", shape[:1]), np.array(found["variance"])
        )
        model = ComponentsModel(fitted, found["input"], found["output"])
        model._resetUid(found["uid"])
        return model


# -- TF-IDF ------------------------------------------------------------------------------------------------------
def save_tfidf(model: TfidfModel, path: str) -> None:
    """The vocabulary as a table, with the name of the session column."""
    spark = model.vocabulary.sparkSession
    model.vocabulary.write.parquet(f"{path}/vocabulary")
    spark.createDataFrame([(json.dumps({"session": model.session}),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load_tfidf(spark: SparkSession, path: str) -> TfidfModel:
    settings = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return TfidfModel(spark.read.parquet(f"{path}/vocabulary"), settings["session"])


# -- scores ------------------------------------------------------------------------------------------------------
class PredictionEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """``accuracy``, exact ``auc`` (0.5 for one class) or ``logloss`` of ``label``, ``prediction`` and ``probability``.

    An instance is also a function of a predictions frame, as searches take it; the loss is then negated, so that more
    is better.
    """

    metricName = Param(Params._dummy(), "metricName", "accuracy, auc or logloss", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metricName: str = "accuracy"):
        super().__init__()
        self._setDefault(metricName="accuracy")
        self._set(**self._input_kwargs)
        if self.getOrDefault(self.metricName) not in ("accuracy", "auc", "logloss"):
            raise ValueError(f"unknown metric: {metricName}")

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getOrDefault(self.metricName)
        if name == "accuracy":
            return metrics.accuracy(dataset).first()["accuracy"]
        if name == "auc":
            return metrics.auc_or_half(dataset)
        p = F.greatest(F.least("probability", F.lit(1 - 1e-12)), F.lit(1e-12))
        return metrics.mean_logit_loss(dataset.withColumn("z", F.log(p / (1 - p)))).first()["loss"]

    def isLargerBetter(self) -> bool:
        return self.getOrDefault(self.metricName) != "logloss"

    def __call__(self, predictions: DataFrame) -> float:
        value = self.evaluate(predictions)
        return value if self.isLargerBetter() else -value


# -- replay ------------------------------------------------------------------------------------------------------
def save_run(model: PipelineModel, folder: str, name: str) -> str:
    """The run's whole pipeline below ``folder``; put the path into the log as the parameter ``saved_model``."""
    path = f"{folder.rstrip('/')}/{name}"
    model.write().save(path)
    return path


def replay_saved(runs: DataFrame, test: DataFrame) -> DataFrame:
    """Test accuracy and AUC of logged runs from their saved models, in order of time; nothing is fitted.

    ``runs`` are the selected entries of the experiment log, a handful of rows; entries without a saved model are left out.
    """
    spark, rows = test.sparkSession, []
    saved = runs.where(F.col("hyperparameters")["saved_model"].isNotNull()).orderBy("timestamp", F.col("hyperparameters")["saved_model"])
    for number, run in enumerate(saved.collect(), start=1):
        predictions = models.predict(PipelineModel.load(run["hyperparameters"]["saved_model"]), test)
        values = {r["metric"]: r["value"] for r in metrics.evaluate(predictions).collect()}
        rows.append((number, dict(run["hyperparameters"]), values["accuracy"], values["auc"], int(values["rows"])))
    return spark.createDataFrame(rows, "number int, params map<string,string>, test_accuracy double, test_auc double, rows long")
