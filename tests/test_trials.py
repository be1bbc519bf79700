"""The trial queue, training by epochs, and saved models."""

import threading
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewire.operators import epochs, models, search, trials

POINTS = [{"x": i} for i in range(12)]


def test_failing_trials_and_resume(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def objective(params):
        calls.append(params["x"])
        if params["x"] == 3:
            raise ValueError("no")
        return {"value": params["x"] / 10, "val_auc": 0.5}

    got = {r.number: r for r in trials.run_trials(spark, path, POINTS[:5], objective, parallelism=3).collect()}
    assert [got[i].state for i in range(5)] == ["COMPLETE"] * 3 + ["FAIL", "COMPLETE"]
    assert got[4].value == 0.4 and got[4].val_auc == 0.5 and got[4].params == {"x": "4"} and "ValueError: no" in got[3].error
    assert got[0].started <= got[0].ended and sorted(calls) == [0, 1, 2, 3, 4]
    trials.run_trials(spark, path, POINTS[:5], objective)
    assert len(calls) == 5  # a failed trial is not tried again by itself
    again = trials.run_trials(spark, path, POINTS[:5], objective, attempts=3).where("number = 3").first()
    assert again.attempt == 3 and calls.count(3) == 3


def test_no_trial_runs_twice(spark, tmp_path):
    """Six queues over one folder, as six drivers would have them."""
    path, calls, lock = str(tmp_path / "t"), [], threading.Lock()

    def objective(params):
        with lock:
            calls.append(params["x"])
        return 1.0

    threads = [threading.Thread(target=trials.run_trials, args=(spark, path, POINTS, objective, 2)) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    trials.run_trials(spark, path, POINTS, objective)  # claims that were taken back by all
    assert sorted(calls) == [p["x"] for p in POINTS]


def test_lost_drivers_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    lost = trials.TrialLedger(spark, path, "lost")
    assert lost.claim(0, 1) and trials.TrialLedger(spark, path).claim(0, 1) is None
    table = trials.run_trials(spark, path, POINTS[:2], lambda p: 1.0)
    assert {r.number: r.state for r in table.collect()} == {0: "RUNNING", 1: "COMPLETE"}
    table = trials.run_trials(spark, path, POINTS[:2], lambda p: 1.0, attempts=2, expire_after=0)
    assert {r.number: (r.state, r.attempt) for r in table.collect()} == {0: ("COMPLETE", 2), 1: ("COMPLETE", 1)}
    assert trials.TrialLedger(spark, str(tmp_path / "none")).table().count() == 0


def test_frames_are_made_once_per_mode():
    made = []
    get = trials.frames_by_mode(lambda mode: (made.append(mode), mode))
    threads = [threading.Thread(target=get, args=(m,)) for m in "abab" * 5]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == ["a", "b"] and get("a")[1] == "a"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for i in range(300):
        x = rng.normal(size=4)
        made.append((date(2020, 1, 1) + timedelta(days=i // 2), f"t{i % 2}", int(x[0] * x[1] > 0), [float(v) for v in x]))
    df = spark.createDataFrame(made, "trading_date date, ticker string, label int, x array<double>")
    return df.select("trading_date", "ticker", "label", array_to_vector("x").alias("features")).persist()


BASE = {"hidden_size": 8, "num_layers": 2, "learning_rate": 0.01, "dropout": 0.3, "weight_decay": 1e-3, "batch_size": 32, "max_epochs": 2}


def weights_of(model):
    return model.stages[-1].weights


@pytest.fixture(scope="module")
def base_weights(rows):
    return weights_of(models.fit("MLP", BASE, rows))


@pytest.mark.parametrize("name, value", [("hidden_size", 16), ("num_layers", 3), ("learning_rate", 0.02), ("dropout", 0.5), ("weight_decay", 0.1), ("batch_size", 64), ("max_epochs", 3), ("seed", 1)])
def test_every_parameter_changes_the_fit(rows, base_weights, name, value):
    other = weights_of(models.fit("MLP", {**BASE, name: value}, rows))
    assert other.shape != base_weights.shape or np.abs(other - base_weights).max() > 1e-6


def test_swept_names_are_live(rows, base_weights):
    assert np.allclose(base_weights, weights_of(models.fit("MLP", BASE, rows.repartition(5))), atol=1e-9)  # the cluster's shape does not matter
    for space in (search.PERCEPTRON_SPACE, search.SEQUENCE_SPACE):
        assert set(space) - {"mode"} <= models.PARAMETERS["MLP"]
    with pytest.raises(ValueError):
        models.fit("MLP", {"max_iter": 5}, rows)
    grid = {"max_depth": [30, None], "min_samples_split": [20, 50], "n_estimators": [5]}
    assert len(search.sample_points(grid, 9, kind="RF")) == 1 and len(search.sample_points(grid, 9)) == 4


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    shapes = epochs.layer_shapes(3, [5, 4])
    w = epochs.first_weights(shapes, 1)
    x, y, weight = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float), rng.random(7) + 0.5

    def loss(w):
        z = epochs.logits(w, shapes, x)
        return ((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))) * weight).sum() / weight.sum()

    slope = epochs.gradient(w, shapes, x, y, weight, 0.0, rng)
    for i in rng.choice(len(w), 20, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        assert slope[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_best_epoch_by_validation_and_many_slots(spark, rows, monkeypatch):
    monkeypatch.setattr(epochs, "SLOT_ROWS", 60)
    train, val = rows.where("trading_date < '2020-04-01'"), rows.where("trading_date >= '2020-04-01'")
    model = models.fit_with_validation("MLP", {"hidden_size": 32, "learning_rate": 0.03, "dropout": 0.0, "max_epochs": 12, "patience": 3}, train, val)
    net = model.stages[-1]
    assert net.history[net.best_epoch] == min(net.history) and len(net.history) <= net.best_epoch + 4
    assert search.accuracy_metric(models.predict(model, train)) > 0.8


def test_saved_models_predict_the_same(spark, rows, tmp_path):
    model = models.fit("MLP", BASE, rows)
    model.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    key = ["trading_date", "ticker"]
    both = models.predict(model, rows).join(models.predict(back, rows).select(*key, F.col("probability").alias("p")), key)
    assert both.count() == 300 and both.where("p <> probability").count() == 0
    assert back.stages[-1].history == model.stages[-1].history
