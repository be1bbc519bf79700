"""Saved stages, evaluators, and the entry without its optional part."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewire.operators import models, search, stages, tfidf
from tidewire.operators.scaling import PopulationScaler
from tidewire.operators.sessions import SESSION
from tidewire.sources import experiments

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    made = [(i, int(x[0] > 0), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(120, 6)))]
    df = spark.createDataFrame(made, "id int, label int, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")).persist()


def test_components_in_a_saved_pipeline(spark, rows, tmp_path):
    pipeline = Pipeline(stages=[PopulationScaler(inputCol="features", outputCol="scaled"), stages.Components(inputCol="scaled", outputCol="pc", k=3)])
    model = pipeline.fit(rows)
    model.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    cells = [np.array(m.transform(rows).orderBy("id").select(vector_to_array("pc").alias("pc")).toPandas()["pc"].tolist()) for m in (model, back)]
    assert cells[0].shape == (120, 3) and np.array_equal(*cells)
    assert abs(cells[0].mean(axis=0)).max() < 1e-9
    assert np.array_equal(model.stages[-1].fitted.explained_variance, back.stages[-1].fitted.explained_variance)


def test_saved_tfidf(spark, tmp_path):
    counts = spark.createDataFrame([("2020-01-01", "oil", 2), ("2020-01-01", "gas", 1), ("2020-01-02", "oil", 1)], f"{SESSION} string, term string, tf long")
    model = tfidf.TfidfVectorizer(10).fit(counts, counts.select(SESSION))
    stages.save_tfidf(model, str(tmp_path / "t"))
    back = stages.load_tfidf(spark, str(tmp_path / "t"))
    assert back.terms() == model.terms() and sorted(back.transform(counts).collect()) == sorted(model.transform(counts).collect())


def test_evaluators(spark, rows, tmp_path):
    made = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.2), (1, 0, 0.4), (0, 0, 0.5)], "label int, prediction int, probability double")
    assert stages.PredictionEvaluator().evaluate(made) == 0.75
    assert stages.PredictionEvaluator(metricName="auc").evaluate(made) == 0.75
    loss = stages.PredictionEvaluator(metricName="logloss")
    want = -np.mean(np.log([0.9, 0.8, 0.4, 0.5]))
    assert loss.evaluate(made) == pytest.approx(want) and not loss.isLargerBetter() and loss(made) == pytest.approx(-want)
    loss.write().save(str(tmp_path / "e"))
    assert stages.PredictionEvaluator.load(str(tmp_path / "e")).evaluate(made) == loss.evaluate(made)
    with pytest.raises(ValueError):
        stages.PredictionEvaluator(metricName="speed")
    dated = rows.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id")).alias("trading_date"), F.lit("A").alias("ticker"), "label", "features")
    found = search.time_series_search(dated, "LR", [{"C": 1e-6}, {"C": 10.0}], k=2, metric=loss)
    assert found.best_params == {"C": 10.0} and found.best_score < 0


def test_replay_from_saved_models(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    model = models.fit("LR", {"C": 1.0}, rows)
    where = stages.save_run(model, str(tmp_path / "models"), "first")
    experiments.log_run(spark, path, {"timestamp": "2026-01-01 00:00:00", "model_type": "LR", "hyperparameters": {"C": 1.0, "saved_model": where}})
    experiments.log_run(spark, path, {"timestamp": "2026-01-02 00:00:00", "model_type": "LR", "hyperparameters": {"C": 2.0}})
    log = experiments.read_log(spark, path)
    got = stages.replay_saved(log, rows).collect()
    assert len(got) == 1 and got[0].test_accuracy == search.accuracy_metric(models.predict(model, rows)) and got[0].rows == 120
    assert [search.typed(r["hyperparameters"]) for r in log.orderBy("timestamp").collect()] == [{"C": 1.0}, {"C": 2.0}]


@pytest.mark.parametrize("missing", ["ahocorasick", "zstandard", "tidewire.llm"])
def test_entry_without_the_optional_part(missing):
    code = f"""
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing + "."!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = set(entry.queries())
assert "daily_sentiment" in names and set(entry.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
