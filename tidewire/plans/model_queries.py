"""Queries over predictions and models: metrics, fits, search, reduction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.numeric import rounded, sigmoid
from tidewire.operators import daily, master, metrics, models, reduction, search, sequences, splits, stages, trials
from tidewire.operators.prices import PRICE_FEATURES, up_down_days
from tidewire.operators.sessions import SESSION
from tidewire.plans import standins
from tidewire.plans.price_queries import SENTIMENT, bars, master_table, timeline
from tidewire.plans.registry import register
from tidewire.plans.sqlviews import r6, with_views
from tidewire.plans.study import SignalStudy, nested_sweep, news_terms, news_tfidf, tuned_bar_forest
from tidewire.session import materialise, scratch_path
from tidewire.sources import experiments

_COUNTS = """counts AS (SELECT count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS n00,
  count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS n01,
  count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS n10,
  count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS n11 FROM predictions),
rates AS (SELECT *, coalesce(n00 / nullif(n00 + n10, 0), 0) AS p0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS r0,
  coalesce(n11 / nullif(n11 + n01, 0), 0) AS p1, coalesce(n11 / nullif(n11 + n10, 0), 0) AS r1,
  n00 + n01 AS s0, n10 + n11 AS s1 FROM counts),
scores AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
  coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM rates),
report AS (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM scores
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM scores
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM scores
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM scores
  UNION ALL SELECT 'accuracy', (n00 + n11) / (s0 + s1), (n00 + n11) / (s0 + s1), (n00 + n11) / (s0 + s1),
    s0 + s1 FROM scores)"""

_AUC = """(sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
/ (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))"""
# Average ranks: ties share the mean of their places.
_RANKED = """(SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE
AS rk FROM predictions)"""


@register(
    "confusion",
    with_views("predictions", body="""SELECT a.label, b.prediction, count(p.label) AS n FROM (VALUES (0), (1)) a(label)
CROSS JOIN (VALUES (0), (1)) b(prediction) LEFT JOIN predictions p ON p.label = a.label AND p.prediction = b.prediction
GROUP BY 1, 2"""),
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(standins.predictions(spark, sf_dir))


@register(
    "class_report",
    with_views("predictions", body="") + f",\n{_COUNTS}\nSELECT class, {r6('precision')}, {r6('recall')}, {r6('f1')}, "
    "support::BIGINT AS support FROM report",
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(standins.predictions(spark, sf_dir))
    return report.withColumns({c: rounded(c) for c in ("precision", "recall", "f1")})


@register(
    "accuracy",
    with_views("predictions", body=f"SELECT {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END)', 'accuracy')} "
               "FROM predictions"),
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(standins.predictions(spark, sf_dir)).select(rounded("accuracy").alias("accuracy"))


@register("auc_exact", with_views("predictions", body=f"SELECT {r6(_AUC, 'auc')} FROM {_RANKED}"))
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(standins.predictions(spark, sf_dir)).select(rounded("auc").alias("auc"))


@register(
    "roc_points",
    with_views("predictions", body=f"""SELECT probability AS threshold,
{r6('sum(neg) OVER w / sum(neg) OVER ()', 'fpr')}, {r6('sum(pos) OVER w / sum(pos) OVER ()', 'tpr')}
FROM (SELECT probability, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM predictions GROUP BY 1) WINDOW w AS (ORDER BY probability DESC)
UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE"""),
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = metrics.roc_points(standins.predictions(spark, sf_dir))
    return points.withColumns({c: rounded(c) for c in ("fpr", "tpr")})


@register(
    "prob_stats",
    with_views("predictions", body=f"""SELECT {r6('min(probability)', 'min_prob')},
{r6('max(probability)', 'max_prob')}, {r6('avg(probability)', 'mean_prob')} FROM predictions"""),
)
def prob_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.probability_stats(standins.predictions(spark, sf_dir))
    return stats.select(*[rounded(c).alias(c) for c in stats.columns])


@register(
    "evaluate",
    with_views("predictions", body=f"""SELECT metric, {r6('value')} FROM (
SELECT 'accuracy' AS metric, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS value FROM predictions
UNION ALL SELECT 'min_prob', min(probability) FROM predictions UNION ALL SELECT 'max_prob', max(probability) FROM predictions
UNION ALL SELECT 'mean_prob', avg(probability) FROM predictions UNION ALL SELECT 'rows', count(*) FROM predictions
UNION ALL SELECT 'auc', {_AUC} FROM {_RANKED})"""),
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate(standins.predictions(spark, sf_dir)).withColumn("value", rounded("value"))


@register(
    "logloss",
    with_views("predictions", body=f"""SELECT
{r6('avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z))))', 'loss')}
FROM (SELECT label, probability * 4 - 2 AS z FROM predictions)"""),
)
def logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.predictions(spark, sf_dir).withColumn("z", F.col("probability") * 4 - 2)
    return metrics.mean_logit_loss(rows).select(rounded("loss").alias("loss"))


@register(
    "sigmoid_decision",
    with_views("predictions", body=f"""SELECT doc_id, {r6('1 / (1 + exp(-(probability * 4 - 2)))', 'p')},
CASE WHEN 1 / (1 + exp(-(probability * 4 - 2))) > 0.5::DOUBLE THEN 1 ELSE 0 END AS decision FROM predictions"""),
)
def sigmoid_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sigmoid(F.col("probability") * 4 - 2)
    rows = standins.predictions(spark, sf_dir)
    return rows.select("doc_id", rounded(p).alias("p"), (p > 0.5).cast("int").alias("decision"))


@register(
    "fold_auc_mean",
    with_views("predictions", body="") + f""",
folded AS (SELECT CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS fold, p.* FROM predictions p JOIN labels l USING (doc_id)),
ranked AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY probability)
  + (count(*) OVER (PARTITION BY fold, probability) - 1) / 2.0::DOUBLE AS rk FROM folded),
aucs AS (SELECT fold, CASE WHEN min(label) < max(label) THEN {_AUC} END AS auc FROM ranked GROUP BY fold)
SELECT {r6('coalesce(avg(auc), 0.5)', 'mean_auc')} FROM aucs""",
)
def fold_auc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folds by the second label stand for the folds of a search."""
    toxic = standins.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = standins.predictions(spark, sf_dir).join(toxic, "doc_id")
    rows = rows.withColumn("fold", F.when(F.col("toxic") == 1, 2).otherwise(1))
    return search.fold_auc_mean(rows).select(rounded("mean_auc").alias("mean_auc"))


@register(
    "weight_analysis",
    f"""WITH w AS (SELECT pos, avg(v) AS weight FROM (SELECT unnest(embedding)::DOUBLE AS v,
  generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1)
SELECT {r6('avg(abs(weight)) FILTER (pos < 6)', 'price_weight')}, {r6('avg(abs(weight)) FILTER (pos >= 6)', 'text_weight')},
'f' || (SELECT pos FROM w ORDER BY abs(weight) DESC, pos LIMIT 1) AS top_feature,
{r6('(SELECT weight FROM w ORDER BY abs(weight) DESC, pos LIMIT 1)', 'top_weight')} FROM w""",
)
def weight_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean embedding as weights: six price features, the rest text."""
    cells = standins.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("position", "v"))
    weights = cells.groupBy("position").agg(F.avg("v").alias("weight"))
    weights = weights.withColumns(
        {
            "feature": F.concat(F.lit("f"), F.col("position").cast("string")),
            "group": F.when(F.col("position") < 6, "price").otherwise("text"),
        }
    )
    found = metrics.weight_analysis(weights)
    return found.withColumns({c: rounded(c) for c in ("price_weight", "text_weight", "top_weight")})


# Models


def _train_test(spark: SparkSession, sf_dir: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = materialise(master.assemble(master_table(spark, sf_dir), columns), "train-test")
    rows = splits.tail_split(rows, "trading_date", "ticker", eager=True)
    return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def study(spark: SparkSession, sf_dir: str, max_features: int) -> SignalStudy:
    """All feature groups of the stand-in tables on one timeline."""
    scores = standins.session_scores(spark, sf_dir)
    made = SignalStudy(standins.prices(spark, sf_dir))
    made.add_sentiment(daily.daily_sentiment(scores))
    made.add_embedding_components(daily.daily_embedding(scores), 10)
    terms = news_terms(standins.articles(spark, sf_dir, gathered=True), standins.calendar(spark))
    model, _ = news_tfidf(terms, max_features=max_features)
    made.add_tfidf(model, terms)
    return made


@register("study_hybrid_tfidf")
def study_hybrid_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News to terms to vectors to a searched model, evaluated on the untouched tail; one point of the grid."""
    made = study(spark, sf_dir, 5000)
    found, test = made.train("LR", "hybrid_tfidf", {"C": [0.01]})
    frames = made.evaluate("hybrid_tfidf", found.model, test)
    return frames["metrics"]


@register("study_embedding_sequences")
def study_embedding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = standins.session_scores(spark, sf_dir)
    made = SignalStudy(standins.prices(spark, sf_dir))
    made.add_embedding_components(daily.daily_embedding(scores), 60)
    rows = materialise(made.sequence_rows("finbert_emb_hybrid"), "sequences")
    rows = splits.three_way_split(rows, "trading_date", "ticker", eager=True)
    train, val, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    return metrics.evaluate(models.predict(models.fit_with_validation("MLP", {"max_epochs": 10}, train, val), test))


@register("nested_sweep")
def nested_sweep_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = standins.session_scores(spark, sf_dir)
    embedding = materialise(daily.daily_embedding(scores), "daily-embedding")

    def make(size: int) -> SignalStudy:
        made = SignalStudy(standins.prices(spark, sf_dir))
        made.add_embedding_components(embedding, size)
        return made

    configs = [{"name": "small", "hidden_size": 32, "max_epochs": 3}, {"name": "deep", "hidden_size": 32, "num_layers": 3, "max_epochs": 3}]
    return nested_sweep(make, [30, 60], ["finbert_emb_hybrid"], configs)


def _price_train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _train_test(spark, sf_dir, PRICE_FEATURES)


@register("lr_fit")
def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = master.feature_columns("hybrid_finbert", {"finbert": SENTIMENT})
    train, test = _train_test(spark, sf_dir, columns)
    model = models.fit("LR", {"C": 1.0, "l1_ratio": 0.2, "class_weight": "balanced", "max_iter": 200}, train)
    return metrics.evaluate(models.predict(model, test))


@register("lr_weights")
def lr_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = master.feature_columns("hybrid_finbert", {"finbert": SENTIMENT})
    train, _ = _train_test(spark, sf_dir, columns)
    model = models.fit("LR", {"C": 10.0, "max_iter": 200}, train)
    return metrics.weight_analysis(models.feature_weights(model, columns, len(PRICE_FEATURES)))


@register("rf_fit")
def rf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _price_train_test(spark, sf_dir)
    model = models.fit("RF", {"n_estimators": 200, "max_depth": 6, "min_samples_leaf": 5}, train)
    return metrics.evaluate(models.predict(model, test))


@register("rf_bars")
def rf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price-bar forest: last fold, importances by name."""
    names = ["open", "high", "low", "volume", "close"]
    days = up_down_days(bars(spark, sf_dir))
    rows = materialise(master.assemble(days, names, label="up_down"), "bars")
    fold = splits.last_fold(rows, "trading_date", "ticker", eager=True)
    train = fold.where("role = 'train'").drop("fold", "role")
    params = {"n_estimators": 100, "max_depth": 10, "min_samples_split": 20, "min_samples_leaf": 10, "max_features": 1.0}
    model = models.fit("RF", params, train)
    scores = metrics.evaluate(models.predict(model, fold.where("role = 'test'").drop("fold", "role")))
    weights = models.feature_weights(model, names, len(names))
    return scores.unionByName(
        weights.select(F.concat(F.lit("importance_"), "feature").alias("metric"), F.col("weight").alias("value"))
    )


def _three_parts(rows: DataFrame) -> tuple[DataFrame, ...]:
    rows = splits.three_way_split(materialise(rows, "three-parts"), "trading_date", "ticker", 0.6, 0.15, eager=True)
    return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


@register("mlp_fit")
def mlp_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptron on all price features; the validation part chooses the epoch."""
    train, val, test = _three_parts(master_rows(spark, sf_dir))
    return metrics.evaluate(models.predict(models.fit_with_validation("MLP", {"max_epochs": 10}, train, val), test))


def sequence_rows(spark: SparkSession, sf_dir: str, length: int = 5) -> DataFrame:
    return sequences.window_rows(sequences.sequence_windows(timeline(spark, sf_dir), ["return_lag0"], length))


@register("sequence_fit")
def sequence_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five days, three hidden layers."""
    train, val, test = _three_parts(sequence_rows(spark, sf_dir))
    model = models.fit_with_validation("MLP", {"num_layers": 3, "max_epochs": 10}, train, val)
    return metrics.evaluate(models.predict(model, test))


@register("grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _price_train_test(spark, sf_dir)
    points = search.grid_points({"C": [0.1, 10.0], "l1_ratio": [0.0], "max_iter": [50]})
    return search.time_series_search(train, "LR", points).trials.select("point", "params", "fold", "score")


@register("randomized_search")
def randomized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = {**models.BAR_FOREST_GRID, "n_estimators": [100], "max_depth": [10], "max_features": ["sqrt"]}
    found, frames = tuned_bar_forest(bars(spark, sf_dir), grid=grid, draws=1)
    importances = frames["importances"].select(
        F.concat(F.lit("importance_"), "feature").alias("metric"), F.col("importance").alias("value")
    )
    return frames["metrics"].unionByName(importances)


@register("random_sweep")
def random_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four trials over parameters and feature modes, worked through by two driver threads."""
    scores = standins.session_scores(spark, sf_dir)
    made = SignalStudy(standins.prices(spark, sf_dir))
    made.add_sentiment(daily.daily_sentiment(scores))
    made.add_embedding_components(daily.daily_embedding(scores), 60)
    space = {**search.PERCEPTRON_SPACE, "mode": ("choice", [m for m in search.MODES if "tfidf" not in m]), "max_epochs": ("choice", [5])}
    return made.sweep(space, 4, scratch_path(spark, "trials"), parallelism=2)


_TRIAL_POINTS = [{"threshold": t} for t in (0.2, 0.35, 0.5, 0.65, 0.8)] + [{"threshold": None}]


@register(
    "trial_queue",
    with_views("predictions", body=f"""SELECT n::INTEGER AS number, CASE WHEN t IS NULL THEN 'FAIL' ELSE 'COMPLETE' END AS state,
{r6('avg(CASE WHEN t IS NULL THEN NULL WHEN (probability > t)::INTEGER = label THEN 1.0 ELSE 0.0 END)', 'value')},
coalesce(t::DOUBLE::VARCHAR, 'None') AS threshold, CASE WHEN t IS NULL THEN 2 ELSE 1 END AS attempt
FROM predictions, (VALUES (0, 0.2), (1, 0.35), (2, 0.5), (3, 0.65), (4, 0.8), (5, NULL)) AS p(n, t) GROUP BY n, t"""),
)
def trial_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on all predictions as trials, one of which always fails and is tried twice, by two drivers' queues."""
    predictions = materialise(standins.predictions(spark, sf_dir), "predictions")

    def objective(params: dict) -> float:
        cut = float(params["threshold"])
        hit = F.avg(((F.col("probability") > cut).cast("int") == F.col("label")).cast("double"))
        return predictions.agg(hit).first()[0]

    path = scratch_path(spark, "trials")
    trials.run_trials(spark, path, _TRIAL_POINTS[:3], objective, parallelism=2, owner="first")
    found = trials.run_trials(spark, path, _TRIAL_POINTS, objective, parallelism=3, attempts=2, owner="second")
    return found.select("number", "state", rounded("value").alias("value"), F.col("params")["threshold"].alias("threshold"), "attempt")


def master_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.assemble(timeline(spark, sf_dir), PRICE_FEATURES)


@register("replay_runs")
def replay_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log two runs, read the log back, refit each and rank them."""
    train, test = _price_train_test(spark, sf_dir)
    path = scratch_path(spark, "runs")
    for c in (0.1, 10.0):
        entry = {"model_type": "LR", "mode": "price", "hyperparameters": {"logr__C": c, "logr__max_iter": 50}}
        experiments.log_run(spark, path, {**entry, "timestamp": "2026-03-10 21:30:00"})
    runs = experiments.select_runs(
        experiments.read_log(spark, path), "LR", "2026-03-10 21:00:00", "2026-03-10 23:59:59"
    )
    params = [r["hyperparameters"] for r in runs.orderBy(F.col("hyperparameters")["logr__C"]).collect()]
    return experiments.leaderboard(search.replay(train, test, "LR", params), "test_accuracy", "number")


@register(
    "replay_saved",
    with_views("placed", body="""SELECT run AS number, count(*) AS rows, count(*) AS same_predictions, true AS same_scores
FROM placed, (VALUES (1), (2)) AS r(run) WHERE pos >= n - ceil(n * 0.3::DOUBLE) GROUP BY run"""),
)
def replay_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are fitted, saved and logged; from the log their models are loaded, and predict and score as before."""
    train, test = _price_train_test(spark, sf_dir)
    path, folder = scratch_path(spark, "runs"), scratch_path(spark, "models")
    before = {}
    for number, c in enumerate((0.1, 10.0), start=1):
        model = models.fit("LR", {"C": c, "max_iter": 50}, train)
        where = stages.save_run(model, folder, f"run-{number}")
        entry = {"model_type": "LR", "mode": "price", "hyperparameters": {"logr__C": c, "saved_model": where}}
        experiments.log_run(spark, path, {**entry, "timestamp": f"2026-03-10 21:30:0{number}"})
        before[number] = materialise(models.predict(model, test), f"predicted-{number}")
    runs = experiments.select_runs(experiments.read_log(spark, path), "LR", "2026-03-10 21:00:00", "2026-03-10 23:59:59")
    replayed = stages.replay_saved(runs, test)
    found = scores = None
    for number, first in before.items():
        again = models.predict(PipelineModel.load(f"{folder}/run-{number}"), test)
        keys = ["trading_date", "ticker"]
        both = first.join(again.select(*keys, F.col("prediction").alias("p"), F.col("probability").alias("q")), keys)
        same = F.count_if((F.col("p") == F.col("prediction")) & (F.abs(F.col("q") - F.col("probability")) < 1e-12))
        counted = both.agg(F.lit(number).alias("number"), F.count("*").alias("rows"), same.alias("same_predictions"))
        score = metrics.accuracy(first).select(F.lit(number).alias("number"), "accuracy")
        found = counted if found is None else found.unionByName(counted)
        scores = score if scores is None else scores.unionByName(score)
    joined = found.join(scores, "number").join(replayed.select("number", "test_accuracy"), "number")
    return joined.select("number", "rows", "same_predictions", (F.abs(F.col("accuracy") - F.col("test_accuracy")) < 1e-12).alias("same_scores"))


@register("pca_embeddings")
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily.daily_embedding(standins.session_scores(spark, sf_dir))
    return reduction.reduce_days(days, "daily_embedding", 30, "emb_pca")


@register("pca_train_only")
def pca_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily.daily_embedding(standins.session_scores(spark, sf_dir))
    split = splits.row_count_split(days, SESSION)
    return reduction.reduce_days(days, "daily_embedding", 10, "emb_pca", split.where("split = 'train'").drop("split"))


@register(
    "pca_total_variance",
    with_views("session_scores", body=f"""SELECT trading_session_date_utc, {r6('sum((m - c) * (m - c))', 'squared_length')}
FROM (SELECT *, avg(m) OVER (PARTITION BY pos) AS c FROM (
  SELECT trading_session_date_utc, pos, avg(v)::FLOAT::DOUBLE AS m FROM (SELECT trading_session_date_utc,
    unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM session_scores) GROUP BY 1, 2))
GROUP BY 1"""),
)
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components keep the distance of each day from the mean day."""
    days = daily.daily_embedding(standins.session_scores(spark, sf_dir))
    reduced = reduction.reduce_days(days, "daily_embedding", standins.EMBEDDING_WIDTH, "pca")
    values = F.array(*[c for c in reduced.columns if c.startswith("pca_")])
    length = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)
    return reduced.select(SESSION, rounded(length).alias("squared_length"))


@register("pca_tfidf")
def pca_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 components of the 5,000 most frequent terms, both fitted on the training sessions."""
    from tidewire.operators import tfidf
    from tidewire.plans.text_queries import session_days, term_counts

    counts, days = term_counts(spark, sf_dir), session_days(spark, sf_dir)
    train = materialise(splits.row_count_split(days, SESSION).where("split = 'train'").select(SESSION), "train-days")
    model = tfidf.TfidfVectorizer(max_features=5000).fit(counts.join(F.broadcast(train), SESSION, "left_semi"), train)
    return reduction.reduce_days(model.to_vectors(counts, days), "tfidf", 100, "pca", train)
