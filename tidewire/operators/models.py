"""Classifiers as ``pyspark.ml`` pipelines, one factory per model family.

A factory takes the parameter names and values of a grid and the training frame
(``label``, ``features``) and returns an unfitted pipeline.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.epochs import EpochPerceptron
from tidewire.operators.scaling import PopulationScaler

# Default grids of the searches.
LOGISTIC_GRID = {
    "C": [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0],
    "l1_ratio": [0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0],
    "class_weight": [None, "balanced"],
    "tol": [1e-4, 1e-3],
}
BALANCED_LOGISTIC_GRID = {
    "C": [0.1, 1.0, 10.0, 100.0],
    "l1_ratio": [0.0, 0.1, 0.5, 0.9, 1.0],
    "class_weight": ["balanced"],
    "max_iter": [2000],
}
FOREST_GRID = {
    "n_estimators": [200, 400],
    "max_depth": [6, 10, 14],
    "max_features": ["sqrt", "log2"],
    "min_samples_leaf": [5, 10],
}
BAR_FOREST_GRID = {
    "n_estimators": [100, 200, 300, 500],
    "max_depth": [10, 20, 30, None],
    "min_samples_split": [20, 50, 100],
    "min_samples_leaf": [10, 20, 40],
    "max_features": ["sqrt", 1.0],
    "bootstrap": [True],
}

# Spark grows trees to this depth at most.
DEEPEST_TREE = 30


def class_weights(train: DataFrame) -> dict[int, float]:
    """n / (2 * n_c) per class."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def with_class_weights(df: DataFrame, weights: dict[int, float] | None) -> DataFrame:
    """Add the ``weight`` column; 1.0 everywhere without weights."""
    column = F.lit(1.0)
    for c, w in (weights or {}).items():
        column = F.when(F.col("label") == c, F.lit(w)).otherwise(column)
    return df.withColumn("weight", column)


def logistic(params: dict, train: DataFrame) -> Pipeline:
    """Elastic-net logistic regression on scaled features.

    The penalty is ``1 / (C * n)`` on the mean loss; the intercept is free.
    """
    n = max(train.count(), 1)
    model = LogisticRegression(
        featuresCol="scaled",
        weightCol="weight",
        elasticNetParam=params.get("l1_ratio", 0.0),
        regParam=1.0 / (params.get("C", 1.0) * n),
        tol=params.get("tol", 1e-4),
        maxIter=params.get("max_iter", 4000),
        standardization=False,
    )
    return Pipeline(stages=[PopulationScaler(inputCol="features", outputCol="scaled"), model])


def forest(params: dict, train: DataFrame) -> Pipeline:
    """Random forest with a fixed seed.

    An unlimited depth means the deepest tree Spark allows; a smallest node to split
    has no counterpart, the smallest leaf does the same job.
    """
    depth = params.get("max_depth", 5)
    if depth is not None and depth > DEEPEST_TREE:
        raise ValueError(f"max_depth above {DEEPEST_TREE}")
    subset = params.get("max_features", "sqrt")
    model = RandomForestClassifier(
        numTrees=params.get("n_estimators", 100),
        maxDepth=DEEPEST_TREE if depth is None else depth,
        featureSubsetStrategy={1.0: "all"}.get(subset, str(subset)),
        minInstancesPerNode=params.get("min_samples_leaf", 1),
        bootstrap=params.get("bootstrap", True),
        seed=42,
    )
    return Pipeline(stages=[model])


def perceptron(params: dict, train: DataFrame) -> Pipeline:
    """Hidden layers of h, h/2, ... cells (``num_layers`` of them, two by default) on scaled features, trained by epochs.

    With a column ``held_out`` in ``train`` its rows choose the best epoch.
    """
    hidden = params.get("hidden_size", 64)
    model = EpochPerceptron(
        featuresCol="scaled",
        weightCol="weight",
        validationIndicatorCol="held_out" if "held_out" in train.columns else None,
        hiddenSizes=[max(hidden >> i, 1) for i in range(params.get("num_layers", 2))],
        learningRate=params.get("learning_rate", 1e-3),
        dropout=params.get("dropout", 0.2),
        weightDecay=params.get("weight_decay", 1e-4),
        batchSize=params.get("batch_size", 64),
        maxEpochs=params.get("max_epochs", 100),
        patience=params.get("patience", 10),
        seed=params.get("seed", 42),
    )
    return Pipeline(stages=[PopulationScaler(inputCol="features", outputCol="scaled"), model])


FACTORIES = {"LR": logistic, "RF": forest, "MLP": perceptron}

#: Parameters each family reads; ``min_samples_split`` is known to forests but has no effect there.
PARAMETERS = {
    "LR": {"C", "l1_ratio", "class_weight", "tol", "max_iter"},
    "RF": {"n_estimators", "max_depth", "max_features", "min_samples_leaf", "min_samples_split", "bootstrap", "class_weight"},
    "MLP": {"hidden_size", "num_layers", "learning_rate", "dropout", "weight_decay", "batch_size", "max_epochs", "patience", "seed", "class_weight"},
}


def effective(kind: str, params: dict) -> dict:
    """The parameters that decide the fit: points that are equal here give the same model."""
    unknown = set(params) - PARAMETERS[kind]
    if unknown:
        raise ValueError(f"{kind} has no parameters {sorted(unknown)}")
    out = {k: v for k, v in params.items() if k != "min_samples_split"}
    if kind == "RF" and "max_depth" in out and out["max_depth"] is None:
        out["max_depth"] = DEEPEST_TREE
    return out


def fit(kind: str, params: dict, train: DataFrame):
    """Fit one model; class weights come from the training rows. Unknown parameters are refused."""
    params = effective(kind, params)
    weights = class_weights(train) if params.get("class_weight") == "balanced" else None
    return FACTORIES[kind](params, train).fit(with_class_weights(train, weights))


def fit_with_validation(kind: str, params: dict, train: DataFrame, val: DataFrame):
    """``fit`` on ``train``; a perceptron's best epoch is that of the lowest loss on ``val``."""
    if kind != "MLP":
        return fit(kind, params, train)
    both = train.withColumn("held_out", F.lit(False)).unionByName(val.withColumn("held_out", F.lit(True)))
    params = effective(kind, params)
    weights = class_weights(train) if params.get("class_weight") == "balanced" else None
    scaler, net = FACTORIES[kind](params, both).getStages()
    fitted = scaler.fit(train)
    return PipelineModel(stages=[fitted, net.fit(fitted.transform(with_class_weights(both, weights)))])


def predict(model, df: DataFrame) -> DataFrame:
    """``label``, ``prediction`` and the probability of class 1, with the keys kept."""
    scored = model.transform(with_class_weights(df, None))
    added = {"features", "scaled", "weight", "rawPrediction", "probability", "prediction"}
    keep = [c for c in df.columns if c not in added]
    return scored.select(
        *keep, F.col("prediction").cast("int").alias("prediction"),
        F.get(vector_to_array("probability"), 1).alias("probability"),
    )


def feature_weights(model, names: list[str], n_price: int) -> DataFrame:
    """Coefficients or importances by feature name, as input of ``weight_analysis``."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [
        (name, "price" if i < n_price else "text", float(w), i)
        for i, (name, w) in enumerate(zip(names, values.toArray()))
    ]
    return SparkSession.active().createDataFrame(rows, "feature string, group string, weight double, position int")
