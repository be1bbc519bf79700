"""The experiment log (JSON lines) and reports on trials."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The field names of the log format.
LOG_SCHEMA = (
    "timestamp string, model_type string, mode string, best_cv_accuracy double, best_cv_auc double, "
    "best_accuracy double, best_val_auc double, best_val_loss double, rows long, features long, "
    "stocks_used array<string>, hyperparameters map<string,string>"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def log_run(spark: SparkSession, path: str, entry: dict) -> None:
    """Append one run; scores are rounded to four digits, parameters kept as text."""
    row = {name: None for name in spark.createDataFrame([], LOG_SCHEMA).columns}
    row.update({k: round(v, 4) if isinstance(v, float) else v for k, v in entry.items()})
    row["timestamp"] = row["timestamp"] or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    row["hyperparameters"] = {k: str(v) for k, v in (row["hyperparameters"] or {}).items()}
    frame = spark.createDataFrame([tuple(row.values())], LOG_SCHEMA)
    frame.coalesce(1).write.mode("append").json(path)


def select_runs(log: DataFrame, model_type: str, start: str, end: str) -> DataFrame:
    """Runs of one model type inside an inclusive time window."""
    stamp = F.col("timestamp").try_cast("timestamp_ntz")
    window = stamp.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return log.where((F.col("model_type") == model_type) & window)


def complete_trials(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("state") == "COMPLETE")


def top_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    """Best finished trials, renamed for reading; ties go to the earlier trial."""
    best = complete_trials(trials).orderBy(F.desc("value"), "number").limit(n)
    names = {"number": "trial", "value": "accuracy"}
    return best.select(*[F.col(c).alias(names.get(c, c.removeprefix("params_"))) for c in best.columns])


def leaderboard(results: DataFrame, score: str = "test_accuracy", *ties: str) -> DataFrame:
    return results.orderBy(F.desc(score), *ties)
