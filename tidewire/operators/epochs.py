"""A perceptron trained epoch by epoch, with the rows spread over tasks.

Rows are dealt once, by a hash of their content, to slots of bounded size. In an epoch every slot starts from the same weights,
goes through its rows in batches with Adam, and sends its weights back; their mean, weighted by rows, starts the next
epoch. So results depend on the data and the settings, not on the cluster. After each epoch the loss on the validation rows is
taken; the weights of the best epoch are kept, and training ends when no epoch has been better for a while.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasValidationIndicatorCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import materialise

#: Rows of a slot: one slot is one task's work in an epoch.
SLOT_ROWS = 50_000
#: Bytes of all slots' states up to which the driver takes them at once; more come one partition after another.
STATES_BYTES = 256 << 20


# -- the network, for a batch of rows ----------------------------------------------------------------------------
def layer_shapes(width: int, hidden: list[int]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes, sizes[1:]))


def first_weights(shapes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """All weights and offsets in one vector, uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, columns in shapes:
        bound = 1.0 / max(rows, 1) ** 0.5
        parts += [rng.uniform(-bound, bound, rows * columns), rng.uniform(-bound, bound, columns)]
    return np.concatenate(parts)


def layers_of(weights: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the vector as matrix and offset per layer."""
    out, at = [], 0
    for rows, columns in shapes:
        matrix = weights[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        out.append((matrix, weights[at : at + columns]))
        at += columns
    return out


def logits(weights: np.ndarray, shapes: list[tuple[int, int]], x: np.ndarray) -> np.ndarray:
    layers = layers_of(weights, shapes)
    for matrix, offset in layers[:-1]:
        x = np.maximum(x @ matrix + offset, 0.0)
    return (x @ layers[-1][0] + layers[-1][1])[:, 0]


def gradient(weights: np.ndarray, shapes: list[tuple[int, int]], x: np.ndarray, label: np.ndarray, weight: np.ndarray, dropout: float, rng: np.random.Generator) -> np.ndarray:
    """Gradient of the mean logistic loss; hidden cells are left out with probability ``dropout``."""
    layers = layers_of(weights, shapes)
    inputs, gates = [x], []
    for matrix, offset in layers[:-1]:
        cells = inputs[-1] @ matrix + offset
        gate = (cells > 0).astype(float)
        if dropout > 0:
            gate *= (rng.random(cells.shape) >= dropout) / (1.0 - dropout)
        gates.append(gate)
        inputs.append(cells * gate)
    z = (inputs[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
    back = ((1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - label) * weight / max(weight.sum(), 1e-300))[:, None]
    out = np.empty_like(weights)
    found = layers_of(out, shapes)
    for k in range(len(layers) - 1, -1, -1):
        found[k][0][...] = inputs[k].T @ back
        found[k][1][...] = back.sum(axis=0)
        if k:
            back = (back @ layers[k][0].T) * gates[k - 1]
    return out


@dataclass
class Adam:
    """Weights with their running moments, as one vector of three parts."""

    rate: float
    decay: float
    state: np.ndarray
    steps: int

    def step(self, slope: np.ndarray) -> None:
        weights, first, second = self.state
        slope = slope + self.decay * weights
        self.steps += 1
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        scale = np.sqrt(second / (1.0 - 0.999**self.steps)) + 1e-8
        weights -= self.rate * (first / (1.0 - 0.9**self.steps)) / scale


@dataclass(frozen=True)
class Settings:
    shapes: list[tuple[int, int]]
    rate: float
    dropout: float
    decay: float
    batch: int
    seed: int


def train_slot(settings: Settings, state: np.ndarray, steps: int, epoch: int, slot: int, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Adam:
    """One epoch over a slot's rows, in batches and in their order."""
    rng = np.random.default_rng([settings.seed, epoch, slot])
    adam = Adam(settings.rate, settings.decay, state.copy(), steps)
    for low in range(0, len(x), settings.batch):
        rows = slice(low, low + settings.batch)
        adam.step(gradient(adam.state[0], settings.shapes, x[rows], label[rows], weight[rows], settings.dropout, rng))
    return adam


# -- Spark jobs --------------------------------------------------------------------------------------------------
def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _epoch(slots: DataFrame, count: int, settings: Settings, state: np.ndarray, steps: int, epoch: int) -> tuple[np.ndarray, int]:
    """The mean of all slots' states after one epoch, and the steps of the longest; sums are added up by Spark."""
    held = slots.sparkSession.sparkContext.broadcast((settings, state, steps))

    def run(table: pa.Table) -> pa.Table:
        settings, state, steps = held.value
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        x, label, weight = _matrix(table.column("x"))[order], table.column("label").to_numpy()[order], table.column("weight").to_numpy()[order]
        slot = table.column("slot")[0].as_py()
        adam = train_slot(settings, state, steps, epoch, slot, x, label, weight)
        return pa.table({"rows": [len(x)], "steps": [adam.steps], "state": [adam.state.ravel().tobytes()]})

    sums, rows, longest = np.zeros_like(state), 0, steps
    made = slots.groupBy("slot").applyInArrow(run, "rows bigint, steps bigint, state binary")
    for r in made.collect() if count * state.nbytes <= STATES_BYTES else made.toLocalIterator():
        sums += r["rows"] * np.frombuffer(r["state"]).reshape(state.shape)
        rows, longest = rows + r["rows"], max(longest, r["steps"])
    held.unpersist()
    return (sums / rows if rows else state), longest


def _scores(df: DataFrame, features: str, weights: np.ndarray, shapes: list[tuple[int, int]], name: str) -> DataFrame:
    """``df`` with the logit of each row."""
    held = df.sparkSession.sparkContext.broadcast((weights, shapes))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, shapes = held.value
        for batch in batches:
            x = np.array(batch.tolist(), float).reshape(len(batch), -1)
            yield pd.Series(logits(weights, shapes, x) if len(batch) else np.zeros(0))

    return df.withColumn(name, score(features))


def _loss(rows: DataFrame, weights: np.ndarray, shapes: list[tuple[int, int]]) -> float:
    scored = _scores(rows, "x", weights, shapes, "z")
    z, label = F.col("z"), F.col("label")
    each = F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))
    found = scored.agg((F.sum(each * F.col("weight")) / F.sum("weight")).alias("loss")).first()["loss"]
    return float("inf") if found is None else found


class _Perceptron(HasFeaturesCol, HasLabelCol, HasWeightCol, HasValidationIndicatorCol, HasSeed):
    hiddenSizes = Param(Params._dummy(), "hiddenSizes", "cells of each hidden layer", TypeConverters.toListInt)
    learningRate = Param(Params._dummy(), "learningRate", "step size", TypeConverters.toFloat)
    dropout = Param(Params._dummy(), "dropout", "share of hidden cells left out", TypeConverters.toFloat)
    weightDecay = Param(Params._dummy(), "weightDecay", "pull of the weights to 0", TypeConverters.toFloat)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a batch", TypeConverters.toInt)
    maxEpochs = Param(Params._dummy(), "maxEpochs", "epochs at most", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "epochs without a lower loss before the end", TypeConverters.toInt)


class EpochPerceptron(Estimator, _Perceptron, DefaultParamsReadable, DefaultParamsWritable):
    """Binary classifier of hidden layers with rectifiers, trained on ``featuresCol`` and a label of 0 or 1.

    Rows marked in ``validationIndicatorCol`` choose the best epoch and the end; without it the training loss does.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol=None, validationIndicatorCol=None, hiddenSizes=(64, 32), learningRate=1e-3,
                 dropout=0.2, weightDecay=1e-4, batchSize=64, maxEpochs=100, patience=10, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", hiddenSizes=[64, 32], learningRate=1e-3, dropout=0.2, weightDecay=1e-4, batchSize=64, maxEpochs=100, patience=10, seed=42)
        given = {k: list(v) if k == "hiddenSizes" else v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> EpochPerceptronModel:
        weight = F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1.0)
        marked = F.col(self.getValidationIndicatorCol()) if self.isSet(self.validationIndicatorCol) else F.lit(False)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label"),
            weight.cast("double").alias("weight"), marked.alias("held_out"),
        )
        # rounded, as scaling may differ in the last digits with the order in which rows were added up
        rows = rows.withColumn("place", F.xxhash64(F.transform("x", lambda v: F.round(v, 6)), "label", "weight"))
        counted = rows.groupBy("held_out").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).collect()
        sizes = {r["held_out"]: r["n"] for r in counted}
        if not sizes.get(False):
            raise ValueError("no rows to train on")
        slots = -(-sizes[False] // SLOT_ROWS)
        rows = materialise(rows.withColumn("slot", F.pmod("place", F.lit(slots))), "epoch-rows")
        train = rows.where("not held_out")
        judged = rows.where("held_out") if sizes.get(True) else train
        shapes = layer_shapes(counted[0]["width"], self.getOrDefault(self.hiddenSizes))
        get = self.getOrDefault
        settings = Settings(shapes, get(self.learningRate), get(self.dropout), get(self.weightDecay), get(self.batchSize), self.getSeed())
        weights = first_weights(shapes, settings.seed)
        state, steps = np.stack((weights, np.zeros_like(weights), np.zeros_like(weights))), 0
        best, history = (float("inf"), -1, weights), []
        for epoch in range(get(self.maxEpochs)):
            state, steps = _epoch(train, slots, settings, state, steps, epoch)
            loss = _loss(judged, state[0], shapes)
            history.append(loss)
            if loss < best[0]:
                best = (loss, epoch, state[0].copy())
            elif epoch - best[1] >= get(self.patience):
                break
        return EpochPerceptronModel(weights=best[2], shapes=shapes, history=history, best_epoch=best[1], features=self.getFeaturesCol())


class EpochPerceptronModel(Model, MLWritable, MLReadable):
    """The best epoch's weights; ``history`` has the loss of each epoch."""

    def __init__(self, weights: np.ndarray | None = None, shapes: list[tuple[int, int]] | None = None, history: list[float] = (), best_epoch: int = -1, features: str = "features"):
        super().__init__()
        self.weights, self.shapes, self.history, self.best_epoch, self.features = weights, shapes or [], list(history), best_epoch, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = dataset.withColumn("_x", vector_to_array(self.features))
        scored = _scores(kept, "_x", self.weights, self.shapes, "_z").drop("_x")
        p = F.when(F.col("_z") >= 0, 1 / (1 + F.exp(-F.col("_z")))).otherwise(F.exp("_z") / (1 + F.exp("_z")))
        scored = scored.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_z"), F.col("_z")))).withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return scored.withColumn("prediction", (F.col("_z") > 0).cast("double")).drop("_z")

    def copy(self, extra=None) -> EpochPerceptronModel:
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: EpochPerceptronModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"shapes": m.shapes, "history": m.history, "bestEpoch": m.best_epoch, "features": m.features})
        rows = [(int(low), m.weights[low : low + 100_000].tolist()) for low in range(0, len(m.weights), 100_000)]
        self.sparkSession.createDataFrame(rows, "at long, weights array<double>").write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> EpochPerceptronModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = self.sparkSession.read.parquet(f"{path}/data").orderBy("at").collect()  # the weights alone
        model = EpochPerceptronModel(
            np.array([w for r in parts for w in r["weights"]]), [tuple(s) for s in found["shapes"]], found["history"], found["bestEpoch"], found["features"]
        )
        model._resetUid(found["uid"])
        return model
