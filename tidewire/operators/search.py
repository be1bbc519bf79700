"""Expanding-window search, replay of logged runs, and random sweeps."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import metrics, models, trials
from tidewire.operators.splits import fold_blocks


def grid_points(grid: dict) -> list[dict]:
    """All combinations in order of the names, the last one varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def sample_points(grid: dict, n: int, seed: int = 42, kind: str | None = None) -> list[dict]:
    """A seeded sample of the grid without repeats; with ``kind``, without points that are the same fit."""
    points = grid_points(grid)
    if kind is not None:
        points = list({repr(sorted(models.effective(kind, p).items(), key=str)): p for p in reversed(points)}.values())[::-1]
    return random.Random(seed).sample(points, min(n, len(points)))


def accuracy_metric(predictions: DataFrame) -> float:
    """A metric is any function of a predictions frame to a number."""
    return metrics.accuracy(predictions).first()["accuracy"]


@dataclass
class SearchResult:
    best_params: dict
    best_score: float
    best_auc: float
    model: object
    trials: DataFrame


def time_series_search(
    train: DataFrame,
    kind: str,
    points: Sequence[dict],
    k: int = 5,
    date: str = "trading_date",
    tie: str = "ticker",
    metric: Callable[[DataFrame], float] = accuracy_metric,
    parallelism: int = 4,
) -> SearchResult:
    """Best mean metric over expanding folds wins, ties go to the earlier point.

    The winner is refitted on the whole training part.  Its AUC is the mean over the
    folds, those of one class left out.
    """
    spark = train.sparkSession
    blocks = fold_blocks(train, date, tie, k, "_block", eager=True).persist()
    try:
        by_fold = {
            f: (blocks.where(F.col("_block") < f).drop("_block"), blocks.where(F.col("_block") == f).drop("_block"))
            for f in range(1, k + 1)
        }

        def run(task):
            index, fold = task
            model = models.fit(kind, points[index], by_fold[fold][0])
            return index, fold, metric(models.predict(model, by_fold[fold][1])), model

        def fold_auc(fold_and_model):
            fold, model = fold_and_model
            return metrics.auc(models.predict(model, by_fold[fold][1])).first()["auc"]

        # independent jobs from driver threads; each job runs on the cluster
        shared = inheritable_thread_target(spark)
        best, best_mean, best_models, open_models, scores = -1, -math.inf, {}, {}, []
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            tasks = [(i, f) for i in range(len(points)) for f in by_fold]
            for index, fold, score, model in pool.map(shared(run), tasks):
                scores.append((index, fold, score))
                open_models[fold] = model
                if fold == k:  # all folds of this point are in; only the leader's models are kept
                    mean = sum(s for i, _, s in scores if i == index) / k
                    if mean > best_mean:
                        best, best_mean, best_models = index, mean, open_models
                    open_models = {}
            aucs = [a for a in pool.map(shared(fold_auc), best_models.items()) if a is not None]
    finally:
        blocks.unpersist()
    rows = [
        (i, {n: str(v) for n, v in points[i].items()}, f, float(s)) for i, f, s in scores
    ]
    trials = spark.createDataFrame(rows, "point int, params map<string,string>, fold int, score double")
    return SearchResult(
        best_params=points[best],
        best_score=best_mean,
        best_auc=sum(aucs) / len(aucs) if aucs else 0.5,
        model=models.fit(kind, points[best], train),
        trials=trials,
    )


def fold_auc_mean(scored_folds: DataFrame) -> DataFrame:
    """Mean of the exact AUC over folds given as ``fold``, ``label``, ``probability``.

    Folds of one class are left out; 0.5 if that leaves none.
    """
    per_fold = metrics.auc(scored_folds, by=["fold"])
    return per_fold.agg(F.coalesce(F.avg("auc"), F.lit(0.5)).alias("mean_auc"))


def replay(train: DataFrame, test: DataFrame, kind: str, runs: Iterable[dict]) -> DataFrame:
    """Refit each logged parameter set and evaluate it on the test slice.

    ``runs`` are the selected entries of the experiment log: a handful of rows.
    """
    spark = train.sparkSession
    rows = []
    for number, params in enumerate(runs, start=1):
        predictions = models.predict(models.fit(kind, typed(params), train), test)
        values = {r["metric"]: r["value"] for r in metrics.evaluate(predictions).collect()}
        rows.append((number, {k: str(v) for k, v in params.items()}, values["accuracy"], values["auc"]))
    return spark.createDataFrame(
        rows, "number int, params map<string,string>, test_accuracy double, test_auc double"
    )


def typed(params: dict) -> dict:
    """Parameter texts of the log back to numbers, ``None`` and booleans."""
    fixed = {"None": None, "True": True, "False": False}

    def value(v):
        if not isinstance(v, str):
            return v
        if v in fixed:
            return fixed[v]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return v

    # names of the log may carry the pipeline step in front
    return {name.split("__")[-1]: value(v) for name, v in params.items() if name != "saved_model"}


# Ranges of the sweeps, as (kind, arguments).
MODES = [
    "price", "tfidf", "finbert_sent", "finbert_emb", "tfidf_hybrid", "finbert_sent_hybrid", "finbert_emb_hybrid",
]
PERCEPTRON_SPACE = {
    "mode": ("choice", MODES),
    "hidden_size": ("choice", [32, 64, 128, 256]),
    "dropout": ("uniform", 0.3, 0.6),
    "learning_rate": ("log", 1e-4, 1e-2),
    "weight_decay": ("log", 1e-5, 1e-1),
    "batch_size": ("choice", [32, 64, 128]),
}
SEQUENCE_SPACE = {
    "mode": ("choice", MODES),
    "hidden_size": ("choice", [16, 32, 64, 128]),
    "num_layers": ("choice", [1, 2, 3]),
    "dropout": ("uniform", 0.3, 0.6),
    "weight_decay": ("log", 1e-5, 1e-1),
    "learning_rate": ("log", 1e-4, 1e-2),
    "batch_size": ("choice", [32, 64, 128]),
}


def draw(space: dict, number: int, seed: int = 42) -> dict:
    """Parameters of trial ``number``; the same number always gives the same ones."""
    rng = random.Random(f"{seed}-{number}")
    params = {}
    for name, (kind, *args) in space.items():
        if kind == "choice":
            params[name] = rng.choice(args[0])
        elif kind == "uniform":
            params[name] = rng.uniform(*args)
        else:
            params[name] = math.exp(rng.uniform(math.log(args[0]), math.log(args[1])))
    return params


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The trial table; empty if there is none yet."""
    return trials.TrialLedger(spark, path).table()


def random_sweep(
    spark: SparkSession,
    space: dict,
    n_trials: int,
    objective: Callable[[dict], DataFrame],
    path: str,
    seed: int = 42,
    parallelism: int = 1,
) -> DataFrame:
    """Seeded random search over the queue of ``trials``; trials that are finished are not run again.

    ``objective`` maps parameters to the predictions on the validation slice; its
    accuracy is the value, AUC and loss are stored with it.
    """
    points = [draw(space, number, seed) for number in range(n_trials)]
    return trials.run_trials(spark, path, points, lambda params: trials.validation_scores(objective(params)), parallelism)
