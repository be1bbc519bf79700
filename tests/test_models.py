"""Metrics, backtest, models, search, sweeps, the study workflow."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewire.operators import backtest, metrics, models, search
from tidewire.plans.standins import letter_scorer
from tidewire.plans.study import SignalStudy, nested_sweep, news_scores, news_terms, news_tfidf, tuned_bar_forest
from tidewire.session import scratch_path
from tidewire.sources import experiments

PREDICTIONS = "label int, prediction int, probability double"


def scored(spark, labels, scores):
    rows = [(y, int(p > 0.5), float(p)) for y, p in zip(labels, scores)]
    return spark.createDataFrame(rows, PREDICTIONS)


def auc_of(df):
    return metrics.auc(df).first()["auc"]


def test_auc_fixture(spark):
    assert auc_of(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])) == 0.75
    assert auc_of(scored(spark, [0, 1, 1], [0.5, 0.5, 0.5])) == 0.5
    one = scored(spark, [1, 1], [0.2, 0.8])
    assert auc_of(one) is None and metrics.auc_or_half(one) == 0.5


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    # a third of the scores is equal, many others lie very close together
    scores = [0.5 if rng.random() < 0.33 else 0.5 + rng.randrange(50) * 1e-12 for _ in range(300)]
    labels = [rng.randrange(2) for _ in scores]
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = scored(spark, labels, scores)
    assert auc_of(df) == pytest.approx(expected)
    flipped = df.withColumn("probability", 1 - F.col("probability"))
    assert auc_of(flipped) == pytest.approx(1 - expected, abs=1e-3)
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert points[0] == (0, 0) and points[-1] == (1, 1) and area == pytest.approx(expected)


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(0, 1, 0.9)] * 3 + [(1, 1, 0.8)] * 2, PREDICTIONS)
    assert {(r[0], r[1]): r[2] for r in metrics.confusion(df).collect()} == {(0, 0): 0, (0, 1): 3, (1, 0): 0, (1, 1): 2}
    got = {r["class"]: (r["precision"], r["recall"], round(r["f1"], 6), r["support"]) for r in metrics.class_report(df).collect()}
    assert got["0"] == (0.0, 0.0, 0.0, 3)
    assert got["1"] == (0.4, 1.0, round(0.8 / 1.4, 6), 2)
    assert got["accuracy"][0] == 0.4 and got["macro avg"][1] == 0.5 and got["weighted avg"][1] == pytest.approx(0.4)


def test_loss_and_baseline(spark):
    df = spark.createDataFrame([(1, 800.0), (0, -800.0), (1, 0.0)], "label int, z double")
    assert metrics.mean_logit_loss(df).first()[0] == pytest.approx(math.log(2) / 3)
    up = spark.createDataFrame([(1,), (1,), (0,), (1,)], "target_next_day int")
    assert metrics.always_up(up).first()[0] == 0.75


def test_fold_auc_skips_one_class(spark):
    rows = [(1, 0, 0.1), (1, 1, 0.9), (2, 1, 0.5), (2, 1, 0.6)]
    df = spark.createDataFrame(rows, "fold int, label int, probability double")
    assert search.fold_auc_mean(df).first()[0] == 1.0
    assert search.fold_auc_mean(df.where("fold = 2")).first()[0] == 0.5


def test_weight_analysis_first_of_equals(spark):
    rows = [("a", "price", 0.5, 0), ("b", "text", -2.0, 1), ("c", "text", 2.0, 2)]
    df = spark.createDataFrame(rows, "feature string, group string, weight double, position int")
    assert tuple(metrics.weight_analysis(df).first()) == (0.5, 2.0, "b", -2.0)


def test_backtest_fixture(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(4)]
    returns = [0.0, 0.1, -0.2, 0.5]
    rows = [(d, "A", r, p) for d, r, p in zip(days, returns, [1, 0, 1, 1])]
    df = spark.createDataFrame(rows, "trading_date date, ticker string, return_lag0 double, prediction int")
    curve = backtest.backtest(backtest.with_future_return(df)).orderBy("step").collect()
    assert [r["strategy"] for r in curve] == pytest.approx([1, 1.1, 1.1, 1.65])
    assert [r["market"] for r in curve] == pytest.approx([1, 1.1, 0.88, 1.32])
    same = backtest.backtest(df, "same_day").orderBy("step").collect()
    assert [r["strategy"] for r in same] == pytest.approx([1, 1, 1, 0.8, 1.2])
    with pytest.raises(ValueError):
        backtest.backtest(df, "yesterday")


def test_future_return_stays_in_the_ticker(spark):
    rows = [(date(2024, 1, d), t, float(d)) for d in (1, 2) for t in ("A", "B")]
    df = spark.createDataFrame(rows, "trading_date date, ticker string, return_lag0 double")
    got = {(r["ticker"], r["trading_date"].day): r["future_return"] for r in backtest.with_future_return(df).collect()}
    assert got == {("A", 1): 2.0, ("A", 2): 0.0, ("B", 1): 2.0, ("B", 2): 0.0}


# Models


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x = rng.normal(size=3)
        rows.append((date(2020, 1, 1) + timedelta(days=i // 2), f"t{i % 2}", int(x[0] + x[1] > 0), [float(v) for v in x]))
    df = spark.createDataFrame(rows, "trading_date date, ticker string, label int, x array<double>")
    return df.select("trading_date", "ticker", "label", array_to_vector("x").alias("features")).persist()


PARAMS = {
    "LR": {"C": 1.0, "l1_ratio": 0.5, "class_weight": "balanced"},
    "RF": {"n_estimators": 20, "max_depth": 6, "min_samples_leaf": 2},
    "MLP": {"hidden_size": 8, "max_epochs": 50, "learning_rate": 0.01, "dropout": 0.0},
}


@pytest.mark.parametrize("kind", PARAMS)
def test_separable_data_is_learned(spark, separable, kind):
    model = models.fit(kind, PARAMS[kind], separable)
    predictions = models.predict(model, separable)
    assert search.accuracy_metric(predictions) > 0.93
    assert predictions.columns == ["trading_date", "ticker", "label", "prediction", "probability"]
    again = models.predict(models.fit(kind, PARAMS[kind], separable), separable)
    key = ["trading_date", "ticker"]
    both = predictions.join(again.select(*key, F.col("probability").alias("p")), key)
    assert both.where(F.abs(F.col("p") - F.col("probability")) > 1e-9).count() == 0


def test_logistic_penalty_matches_the_objective(spark, separable):
    """At the optimum the gradient of loss + w'w / (2 C n) vanishes."""
    c = 0.05
    model = models.fit("LR", {"C": c, "l1_ratio": 0.0, "tol": 1e-10}, separable)
    rows = separable.collect()
    x = np.array([r["features"].toArray() for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = np.array([r["label"] for r in rows])
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.allclose(x.T @ residual / len(y) + w / (c * len(y)), 0, atol=1e-5)
    assert abs(residual.mean()) < 1e-5


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert models.class_weights(df) == {0: 4 / 6, 1: 2.0}


def test_depth_limit(spark, separable):
    with pytest.raises(ValueError):
        models.fit("RF", {"max_depth": 40}, separable)


def test_search(spark, separable):
    grid = {"C": [1e-6, 1.0], "l1_ratio": [0.0], "max_iter": [50]}
    found = search.time_series_search(separable, "LR", search.grid_points(grid), k=3)
    assert found.best_params["C"] == 1.0 and found.best_score > 0.9 and found.best_auc > 0.95
    assert found.trials.count() == 6
    tie = search.time_series_search(separable, "LR", [{"C": 50.0, "max_iter": 0}, {"C": 60.0, "max_iter": 0}], k=2)
    assert tie.best_params["C"] == 50.0


def test_grid_and_sample():
    assert search.grid_points({"b": [1, 2], "a": ["x"]}) == [{"a": "x", "b": 1}, {"a": "x", "b": 2}]
    assert len(search.grid_points(models.LOGISTIC_GRID)) == 252
    assert len(search.grid_points(models.FOREST_GRID)) == 24
    assert len(search.grid_points(models.BALANCED_LOGISTIC_GRID)) == 20
    drawn = search.sample_points(models.BAR_FOREST_GRID, 20)
    assert len(drawn) == 20 and drawn == search.sample_points(models.BAR_FOREST_GRID, 20)
    assert len({str(p) for p in drawn}) == 20


def test_draws_stay_in_range():
    for n in range(50):
        p = search.draw(search.SEQUENCE_SPACE, n)
        assert p == search.draw(search.SEQUENCE_SPACE, n)
        assert 1e-4 <= p["learning_rate"] <= 1e-2 and 0.3 <= p["dropout"] <= 0.6 and p["num_layers"] in (1, 2, 3)
        assert p["mode"] in search.MODES


def test_sweep_resumes(spark, separable):
    path, seen = scratch_path(spark, "trials"), []

    def objective(params):
        seen.append(params["hidden_size"])
        return models.predict(models.fit("LR", {"C": 1.0, "max_iter": 30}, separable), separable)

    first = search.random_sweep(spark, search.PERCEPTRON_SPACE, 2, objective, path)
    assert first.count() == 2 and len(seen) == 2
    more = search.random_sweep(spark, search.PERCEPTRON_SPACE, 3, objective, path)
    assert more.count() == 3 and len(seen) == 3
    row = more.first()
    assert row["state"] == "COMPLETE" and row["value"] > 0.9 and row["val_auc"] > 0.9 and row["val_loss"] < 0.5
    assert [r["number"] for r in more.orderBy("number").collect()] == [0, 1, 2]


def test_log_and_replay(spark, separable):
    path = scratch_path(spark, "log")
    stamps = ["2026-03-10 20:59:59", "2026-03-10 21:00:00", "2026-03-10 23:59:59", "2026-03-11 00:00:00"]
    for i, stamp in enumerate(stamps):
        experiments.log_run(spark, path, {
            "timestamp": stamp, "model_type": "LR", "mode": "price", "best_cv_accuracy": 0.123456, "stocks_used": ["A"],
            "hyperparameters": {"logr__C": float(i + 1), "logr__class_weight": None}})
    experiments.log_run(spark, path, {"timestamp": stamps[1], "model_type": "RF", "hyperparameters": {}})
    log = experiments.read_log(spark, path)
    assert log.count() == 5 and log.where("best_cv_accuracy = 0.1235").count() == 4
    runs = experiments.select_runs(log, "LR", stamps[1], stamps[2]).orderBy("timestamp").collect()
    assert [search.typed(r["hyperparameters"]) for r in runs] == [{"C": 2.0, "class_weight": None}, {"C": 3.0, "class_weight": None}]
    results = search.replay(separable, separable, "LR", [r["hyperparameters"] for r in runs])
    board = experiments.leaderboard(results, "test_accuracy", "number").collect()
    assert len(board) == 2 and board[0]["test_accuracy"] >= board[1]["test_accuracy"] > 0.9


def test_top_trials(spark):
    rows = [(i, "COMPLETE" if i % 2 else "PRUNED", i / 10, i * 8) for i in range(30)]
    trials = spark.createDataFrame(rows, "number int, state string, value double, params_hidden_size int")
    top = experiments.top_trials(trials, 5)
    assert top.columns == ["trial", "state", "accuracy", "hidden_size"]
    assert [r["trial"] for r in top.collect()] == [29, 27, 25, 23, 21]
    assert experiments.complete_trials(trials).count() == 15


# The study from end to end


def test_study(spark):
    rng = random.Random(11)
    start = date(2020, 1, 1)
    days = [start + timedelta(days=i) for i in range(140)]
    prices = spark.createDataFrame(
        [(d, 50 + rng.random() * 10, t) for d in days for t in ("A", "B")], "date date, close double, ticker string"
    )
    words = "market rises falls profit loss growth oil bank trade deal rate".split()
    news = spark.createDataFrame(
        [(i, d, " ".join(rng.choices(words, k=6))) for i, d in enumerate(days * 3)],
        "article_id long, day date, Article_title string",
    ).select("article_id", F.col("day").cast("timestamp_ntz").alias("date_utc"), "Article_title")
    scored_rows, sentiment, embedding = news_scores(news, letter_scorer)
    assert scored_rows.count() == 420
    terms = news_terms(news)
    model, weights = news_tfidf(terms, max_features=8)
    assert weights.where("weight > 1.0000001 OR weight <= 0").count() == 0

    study = SignalStudy(prices)
    study.add_sentiment(sentiment)
    study.add_embedding_components(embedding, 3)
    study.add_tfidf(model, terms)
    assert study.feature_names("hybrid_tfidf") == [*study.groups["price"], *model.terms()]
    assert study.columns("finbert_emb_hybrid", True) == ["return_lag0", "emb_pca_0", "emb_pca_1", "emb_pca_2"]
    path = scratch_path(spark, "study-log")
    found, test = study.train("LR", "hybrid_tfidf", {"C": [0.1], "max_iter": [20]}, path, k=2)
    n = study.master.count()
    assert test.count() == math.ceil(0.3 * n)
    entry = experiments.read_log(spark, path).first()
    assert (entry["rows"], entry["features"], entry["stocks_used"]) == (n, 14, ["A", "B"])
    frames = study.evaluate("hybrid_tfidf", found.model, test)
    assert {r["metric"] for r in frames["metrics"].collect()} >= {"accuracy", "auc"}
    assert frames["confusion"].agg(F.sum("n")).first()[0] == test.count()
    assert frames["weights"].first()["top_feature"] in study.feature_names("hybrid_tfidf")
    curve = study.backtest(found.model, test)
    assert curve.where("step = 0 AND strategy = 1.0 AND market = 1.0").count() == 2
    assert study.sequence_rows("finbert_sent", 4).count() == n - 2 * 3
    with pytest.raises(ValueError):
        study.columns("hybrid")
    again = study.replay(experiments.read_log(spark, path)).collect()
    assert [r["mode"] for r in again] == ["hybrid_tfidf"] and 0 <= again[0]["test_accuracy"] <= 1


def test_tuned_bar_forest(spark):
    rng = random.Random(14)
    rows, close = [], 100.0
    for i in range(90):
        close *= 1.02 if rng.random() < 0.5 else 0.98
        rows.append((date(2020, 1, 1) + timedelta(days=i), "A", close, close + 1, close - 1, 5.0, close))
    schema = "trading_date date, ticker string, open double, high double, low double, volume double, close double"
    grid = {"n_estimators": [3], "max_depth": [2, 3], "min_samples_leaf": [2]}
    found, frames = tuned_bar_forest(spark.createDataFrame(rows, schema), 61, grid, draws=2, k=2)
    assert found.trials.count() == 4
    assert frames["confusion"].agg(F.sum("n")).first()[0] == 20  # 60 labelled days, the newest of three blocks
    assert frames["importances"].agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_nested_sweep(spark):
    rng = random.Random(13)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(80)]
    prices = spark.createDataFrame([(d, 50 + rng.random()) for d in days], "date date, close double")
    vectors = spark.createDataFrame(
        [(d, [rng.random() for _ in range(5)]) for d in days], "trading_session_date_utc date, daily_embedding array<double>"
    )

    def make(size):
        study = SignalStudy(prices)
        study.add_embedding_components(vectors, size)
        return study

    configs = [{"name": "narrow", "hidden_size": 4, "max_epochs": 3}, {"name": "wide", "hidden_size": 8, "max_epochs": 3}]
    board = nested_sweep(make, [2, 3], ["finbert_emb"], configs, length=3).collect()
    assert {r["run"] for r in board} == {f"{n} | finbert_emb | {c}" for n in (2, 3) for c in ("narrow", "wide")}
    assert [r["test_accuracy"] for r in board] == sorted((r["test_accuracy"] for r in board), reverse=True)


def test_tfidf_components_in_the_study(spark):
    rng = random.Random(12)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    prices = spark.createDataFrame([(d, 50 + rng.random()) for d in days], "date date, close double")
    study = SignalStudy(prices)
    vectors = spark.createDataFrame(
        [(d, [rng.random() for _ in range(5)]) for d in days[::2]], "trading_session_date_utc date, tfidf array<double>"
    )
    study.add_tfidf_components(vectors, 2)
    assert study.columns("tfidf_hybrid")[-2:] == ["pca_0", "pca_1"]
    assert study.master.where("pca_0 IS NULL").count() == 0
    with pytest.raises(ValueError):
        study.add_tfidf_components(vectors, 2, fit_on="some")
