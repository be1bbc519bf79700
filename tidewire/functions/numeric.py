"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.timefn import as_column


def softmax(logits: Column | str) -> Column:
    """Numerically safe softmax of an array column."""
    logits = F.transform(as_column(logits), lambda x: x.cast("double"))
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def sigmoid(z: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-as_column(z)))


def decide(probability: Column | str, threshold: float = 0.5) -> Column:
    """Class 1 only strictly above the threshold."""
    return (as_column(probability) > threshold).cast("int")


def logit_loss(label: Column | str, z: Column | str) -> Column:
    """Binary cross-entropy of a raw score, without overflow."""
    label, z = as_column(label).cast("double"), as_column(z)
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero, for comparisons."""
    return F.round(as_column(c), digits) + F.lit(0.0)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """Division with 0 for a zero denominator."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
