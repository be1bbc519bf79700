"""Exact evaluation metrics as aggregations.

A predictions frame has ``label`` (0/1), ``prediction`` (0/1) and ``probability``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numeric import logit_loss, ratio_or_zero
from tidewire.operators.order import running_totals, score_cells


def _count(label: int, prediction: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))


def confusion(predictions: DataFrame) -> DataFrame:
    """All four cells of the confusion matrix, empty ones as 0."""
    cells = [
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), _count(a, b).alias("n"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return predictions.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted means, accuracy.

    A zero denominator gives 0.  One aggregation; no row leaves its task.
    """
    counts = predictions.agg(*[_count(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n = {(a, b): F.col(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    for c, other in ((0, 1), (1, 0)):
        hit, support = n[c, c], n[c, c] + n[c, other]
        counts = counts.withColumns(
            {
                f"p{c}": ratio_or_zero(hit, hit + n[other, c]),
                f"r{c}": ratio_or_zero(hit, support),
                f"s{c}": support,
            }
        )
        p, r = F.col(f"p{c}"), F.col(f"r{c}")
        counts = counts.withColumn(f"f{c}", ratio_or_zero(2 * p * r, p + r))
    total = F.col("s0") + F.col("s1")
    accuracy = ratio_or_zero(n[0, 0] + n[1, 1], total)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def mean(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return ratio_or_zero(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), total)

    lines = [line(str(c), *[F.col(f"{m}{c}") for m in "prfs"]) for c in (0, 1)]
    lines.append(line("macro avg", mean("p"), mean("r"), mean("f"), total))
    lines.append(line("weighted avg", weighted("p"), weighted("r"), weighted("f"), total))
    lines.append(line("accuracy", accuracy, accuracy, accuracy, total))
    return counts.select(F.inline(F.array(*lines)))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def _by_score(predictions: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with those of all lower scores."""
    positives = F.count_if(F.col("label") == 1).alias("pos")
    negatives = F.count_if(F.col("label") == 0).alias("neg")
    counted = predictions.where(F.col(score).isNotNull()).groupBy(*by, score).agg(positives, negatives)
    return running_totals(counted, score, ["pos", "neg"], score_cells(score), by)


def auc(predictions: DataFrame, score: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties at half; null if there is one class only.

    Rows are counted per distinct score before anything is ordered.  ``by`` gives one
    value per group, such as a fold.
    """
    ranked = _by_score(predictions, score, by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy(*by).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def auc_or_half(predictions: DataFrame, score: str = "probability") -> float:
    """The AUC as a number; 0.5 for a slice of one class."""
    value = auc(predictions, score).first()["auc"]
    return 0.5 if value is None else value


def roc_points(predictions: DataFrame, score: str = "probability") -> DataFrame:
    """False and true positive rates at each distinct threshold, and the point (0, 0)."""
    ranked = _by_score(predictions, score)
    totals = predictions.where(F.col(score).isNotNull()).agg(
        F.struct(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).alias("t")
    )
    ranked = ranked.withColumn("_t", totals.scalar())
    rates = ranked.select(
        F.col(score).cast("double").alias("threshold"),
        F.try_divide((F.col("_t.neg") - F.col("neg_before")).cast("double"), F.col("_t.neg")).alias("fpr"),
        F.try_divide((F.col("_t.pos") - F.col("pos_before")).cast("double"), F.col("_t.pos")).alias("tpr"),
    )
    start = predictions.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(rates)


def probability_stats(predictions: DataFrame, probability: str = "probability") -> DataFrame:
    return predictions.agg(
        F.min(probability).alias("min_prob"),
        F.max(probability).alias("max_prob"),
        F.avg(probability).alias("mean_prob"),
    )


def mean_logit_loss(df: DataFrame, label: str = "label", z: str = "z") -> DataFrame:
    return df.agg(F.avg(logit_loss(label, z)).alias("loss"))


def always_up(df: DataFrame, label: str = "target_next_day") -> DataFrame:
    """Accuracy of always predicting a rise."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("baseline_accuracy"))


def weight_analysis(weights: DataFrame) -> DataFrame:
    """Mean absolute weight of each feature group and the most influential feature.

    ``weights`` has ``feature``, ``group`` (price or text), ``weight`` and ``position``;
    of equal magnitudes the first position wins.
    """
    size = F.abs("weight")

    def group_mean(name: str) -> Column:
        return F.avg(F.when(F.col("group") == name, size))

    top = F.max_by(F.struct("feature", "weight"), F.struct(size, -F.col("position")))
    one = weights.agg(group_mean("price").alias("price_weight"), group_mean("text").alias("text_weight"), top.alias("top"))
    return one.select(
        "price_weight", "text_weight", F.col("top.feature").alias("top_feature"), F.col("top.weight").alias("top_weight")
    )


def evaluate(predictions: DataFrame) -> DataFrame:
    """Accuracy, AUC and probability range as ``(metric, value)`` rows."""
    joined = predictions.agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.min("probability").alias("min_prob"),
        F.max("probability").alias("max_prob"),
        F.avg("probability").alias("mean_prob"),
        F.count(F.lit(1)).cast("double").alias("rows"),
    )
    joined = joined.withColumn("auc", F.coalesce(auc(predictions).scalar(), F.lit(0.5)))
    names = joined.columns
    return joined.unpivot([], names, "metric", "value")
