"""The whole study in a few calls: news to features, features to models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import backtest, daily, master, metrics, models, reduction, search, sequences, splits, tfidf, trials
from tidewire.operators.prices import PRICE_FEATURES, price_timeline, up_down_days
from tidewire.operators.scoring import Scorer, score_articles
from tidewire.operators.sessions import SESSION, assign_sessions
from tidewire.session import materialise
from tidewire.sources import experiments
from tidewire.sources.prices import first_days

KEYS = ("trading_date", "ticker")


def news_terms(articles: DataFrame, calendar: DataFrame | None = None, stemmed: bool = True) -> DataFrame:
    """Articles to term counts per session, written once."""
    placed = assign_sessions(articles, "date_utc", calendar)
    return materialise(tfidf.daily_tokens(placed, stemmed=stemmed), "daily-tokens")


def news_tfidf(
    terms: DataFrame, train_ratio: float = 0.7, max_features: int = 5000
) -> tuple[tfidf.TfidfModel, DataFrame]:
    """Vocabulary of the earliest sessions, and the weights of all."""
    days = terms.select(SESSION).where(F.col(SESSION).isNotNull()).distinct()
    train_days = splits.row_count_split(days, SESSION, train_ratio).where("split = 'train'").select(SESSION)
    train_terms = terms.join(train_days, SESSION, "left_semi")
    model = tfidf.TfidfVectorizer(max_features).fit(train_terms, train_days)
    return model, model.transform(terms)


def news_scores(
    articles: DataFrame, scorer_factory: Callable[[], Scorer], calendar: DataFrame | None = None, batch_size: int = 128
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored articles (written once), daily sentiment and daily embeddings."""
    titled = articles.where(F.col("Article_title").isNotNull())
    scored = materialise(score_articles(titled, scorer_factory, batch_size=batch_size), "scored")
    placed = assign_sessions(scored, "date_utc", calendar)
    return scored, daily.daily_sentiment(placed), daily.daily_embedding(placed)


class SignalStudy:
    """Price timeline, feature groups, training and evaluation.

    ``fit_on='train'`` fits components on the days before the test part only;
    ``'all'`` uses every day, which lets the test days shape them.
    """

    def __init__(self, prices: DataFrame, start=None, end=None, test_size: float = 0.3):
        # read by every later step, so computed once
        self.timeline = materialise(price_timeline(prices, start, end), "timeline")
        self.master = self.timeline
        self.test_size = test_size
        self.groups: dict[str, list[str]] = {"price": list(PRICE_FEATURES)}
        self.names: dict[str, list[str]] = {"price": list(PRICE_FEATURES)}

    def _add(self, group: str, features: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        columns = master.feature_names(features)
        self.master = master.join_features(self.master, features)
        self.groups[group] = columns
        self.names[group] = list(names) if names is not None else columns
        return self.master

    def add_sentiment(self, daily_sentiment: DataFrame, group: str = "finbert") -> DataFrame:
        """Daily sentiment as is; the same columns serve the classic and the neural modes."""
        self._add(group, daily_sentiment)
        for alias in ("finbert", "finbert_sent"):
            self.groups[alias], self.names[alias] = self.groups[group], self.names[group]
        return self.master

    def add_tfidf(self, model: tfidf.TfidfModel, terms: DataFrame) -> DataFrame:
        """One sparse vector per trading day, the zero vector without news."""
        days = self.timeline.select(F.col("trading_date").alias(SESSION)).distinct()
        return self._add("tfidf", model.to_vectors(terms, days), model.terms())

    def _train_days(self) -> DataFrame:
        cut = splits.cutoff_date(self.timeline, "trading_date", 1.0 - self.test_size)
        early = self.timeline.where(F.col("trading_date") < cut)
        return early.select(F.col("trading_date").alias(SESSION)).distinct()

    def _add_components(self, group: str, vectors: DataFrame, column: str, n: int, prefix: str, fit_on: str):
        if fit_on not in ("train", "all"):
            raise ValueError(f"unknown fit_on: {fit_on}")
        train = self._train_days() if fit_on == "train" else None
        return self._add(group, reduction.reduce_days(vectors, column, n, prefix, train))

    def add_tfidf_components(self, vectors: DataFrame, n: int = 100, fit_on: str = "train") -> DataFrame:
        return self._add_components("tfidf", vectors, "tfidf", n, "pca", fit_on)

    def add_embedding_components(self, daily_embedding: DataFrame, n: int = 30, fit_on: str = "train") -> DataFrame:
        return self._add_components("finbert_emb", daily_embedding, "daily_embedding", n, "emb_pca", fit_on)

    def _modes(self, mode: str) -> dict:
        return master.CLASSIC_MODES if mode in master.CLASSIC_MODES else master.NEURAL_MODES

    def columns(self, mode: str, for_sequences: bool = False) -> list[str]:
        return master.feature_columns(mode, self.groups, self.master.columns, self._modes(mode), for_sequences)

    def flat_rows(self, mode: str) -> DataFrame:
        """One row per day and ticker: keys, label, feature vector."""
        return master.assemble(self.master, self.columns(mode), KEYS)

    def sequence_rows(self, mode: str, length: int = 5) -> DataFrame:
        """One row per window of days, flattened into the feature vector."""
        windows = sequences.sequence_windows(self.master, self.columns(mode, for_sequences=True), length)
        return sequences.window_rows(windows)

    def train(
        self, kind: str, mode: str, grid: dict | Sequence[dict], log_path: str | None = None, k: int = 5
    ) -> tuple[search.SearchResult, DataFrame]:
        """Search on the early part; gives the result and the untouched test rows."""
        rows = materialise(self.flat_rows(mode), f"study-{mode}")
        rows = splits.tail_split(rows, "trading_date", "ticker", self.test_size, eager=True)
        train, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "test"))
        points = search.grid_points(grid) if isinstance(grid, dict) else list(grid)
        found = search.time_series_search(train, kind, points, k)
        if log_path:
            tickers = [r[0] for r in self.timeline.select("ticker").distinct().orderBy("ticker").collect()]
            experiments.log_run(
                self.master.sparkSession,
                log_path,
                {
                    "model_type": kind, "mode": mode, "best_cv_accuracy": found.best_score,
                    "best_cv_auc": found.best_auc, "rows": rows.count(), "features": len(self.feature_names(mode)),
                    "stocks_used": tickers, "hyperparameters": found.best_params,
                },
            )
        return found, test

    def sweep(
        self, space: dict, n_trials: int, path: str, kind: str = "MLP", length: int | None = None, seed: int = 42, parallelism: int = 4
    ) -> DataFrame:
        """Random trials over parameters and feature modes; the table of trials.

        The first 60 % train, the next 15 % choose the epoch and give the value. Each mode's rows are made once,
        whichever trial asks first; ``length`` makes them windows of days.
        """

        def make(mode: str) -> tuple[DataFrame, DataFrame]:
            made = self.flat_rows(mode) if length is None else self.sequence_rows(mode, length)
            rows = splits.three_way_split(materialise(made, f"sweep-{mode}"), "trading_date", "ticker", 0.6, 0.15, eager=True)
            return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "val"))

        frames = trials.frames_by_mode(make)

        def objective(params: dict) -> DataFrame:
            train, val = frames(params["mode"])
            settings = {k: v for k, v in params.items() if k != "mode"}
            return models.predict(models.fit_with_validation(kind, settings, train, val), val)

        return search.random_sweep(self.master.sparkSession, space, n_trials, objective, path, seed, parallelism)

    def replay(self, runs: DataFrame) -> DataFrame:
        """Refit and test the selected entries of the experiment log, each in its own mode.

        The entries are a handful of rows; the best test accuracy comes first.
        """
        rows = []
        for number, run in enumerate(runs.orderBy("timestamp", "mode").collect(), start=1):
            params = search.typed(run["hyperparameters"])
            found, test = self.train(run["model_type"], run["mode"], [params])
            scores = _scores(models.predict(found.model, test))
            rows.append((number, run["mode"], found.best_score, found.best_auc, *scores))
        schema = (
            "number int, mode string, cv_accuracy double, cv_auc double, test_accuracy double, test_auc double"
        )
        results = self.master.sparkSession.createDataFrame(rows, schema)
        return experiments.leaderboard(results, "test_accuracy", "number")

    def feature_names(self, mode: str) -> list[str]:
        """Names in vector order; a TF-IDF vector counts one name per term."""
        return [n for group in self._modes(mode)[mode] for n in self.names[group]]

    def evaluate(self, mode: str, model, test: DataFrame) -> dict[str, DataFrame]:
        """Metrics, class report, confusion matrix, ROC points and weight analysis."""
        predictions = models.predict(model, test)
        frames = {
            "metrics": metrics.evaluate(predictions),
            "report": metrics.class_report(predictions),
            "confusion": metrics.confusion(predictions),
            "roc": metrics.roc_points(predictions),
        }
        last = model.stages[-1]
        if hasattr(last, "coefficients") or hasattr(last, "featureImportances"):
            n_price = len(self.names["price"]) if "price" in self._modes(mode)[mode] else 0
            weights = models.feature_weights(model, self.feature_names(mode), n_price)
            frames["weights"] = metrics.weight_analysis(weights)
        return frames

    def backtest(self, model, test: DataFrame, alignment: str = "next_day") -> DataFrame:
        """Growth of strategy and market over the test rows."""
        returns = backtest.with_future_return(self.timeline).select(*KEYS, "return_lag0", "future_return")
        predictions = models.predict(model, test).join(returns, list(KEYS))
        return backtest.backtest(predictions, alignment)


def _scores(predictions: DataFrame) -> tuple[float, float]:
    values = {r["metric"]: r["value"] for r in metrics.evaluate(predictions).collect()}
    return values["accuracy"], values["auc"]


BAR_FEATURES = ["open", "high", "low", "volume", "close"]


def tuned_bar_forest(
    bars: DataFrame, n_rows: int | None = None, grid: dict | None = None, draws: int = 20, k: int = 5
) -> tuple[search.SearchResult, dict[str, DataFrame]]:
    """Random forest on daily bars: seeded draws from the grid, searched on expanding folds.

    The best setting is refitted on the rows before the newest fold and tested on that fold.
    ``n_rows`` keeps the first rows in time order.
    """
    rows = bars if n_rows is None else first_days(bars, n_rows, "trading_date")
    labelled = master.assemble(up_down_days(rows), BAR_FEATURES, KEYS, "up_down")
    labelled = materialise(labelled, "bars")
    points = search.sample_points(models.BAR_FOREST_GRID if grid is None else grid, draws, kind="RF")
    found = search.time_series_search(labelled, "RF", points, k)
    fold = splits.last_fold(labelled, "trading_date", "ticker", k, eager=True)
    train, test = (fold.where(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
    model = models.fit("RF", found.best_params, train)
    predictions = models.predict(model, test)
    weights = models.feature_weights(model, BAR_FEATURES, len(BAR_FEATURES))
    return found, {
        "metrics": metrics.evaluate(predictions),
        "confusion": metrics.confusion(predictions),
        "importances": weights.select("feature", F.col("weight").alias("importance")),
    }


def nested_sweep(
    make_study: Callable[[int], SignalStudy],
    sizes: Sequence[int],
    modes: Sequence[str],
    configs: Sequence[dict],
    kind: str = "MLP",
    length: int = 5,
) -> DataFrame:
    """Every component count, mode and named configuration, ranked by test accuracy.

    ``make_study`` builds the study for a component count.  Training uses the first
    60 %, validation the next 15 %, the rest is tested once.
    """
    rows = []
    for size in sizes:
        study = make_study(size)
        spark = study.master.sparkSession
        for mode in modes:
            windows = materialise(study.sequence_rows(mode, length), "sequences")
            windows = splits.three_way_split(windows, "trading_date", "ticker", 0.6, 0.15, eager=True)
            part = {s: windows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
            for config in configs:
                params = {k: v for k, v in config.items() if k != "name"}
                model = models.fit_with_validation(kind, params, part["train"], part["val"])
                val_accuracy, _ = _scores(models.predict(model, part["val"]))
                scores = _scores(models.predict(model, part["test"]))
                rows.append((f"{size} | {mode} | {config['name']}", *scores, val_accuracy))
    results = spark.createDataFrame(rows, "run string, test_accuracy double, test_auc double, val_accuracy double")
    return experiments.leaderboard(results, "test_accuracy", "run")
