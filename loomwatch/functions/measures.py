"""Measures of a binary classifier as expressions over tp, fp, fn and tn. Undefined ones are null, never zero."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def confusion(truth: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(truth & pred).alias("tp"),
        F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"),
        F.count_if(~truth & ~pred).alias("tn"),
    ]


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def measures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
        "specificity": specificity,
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(product)),
    }


def z_of(confidence: float) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def wilson(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """(point, low, high, n) of a proportion; an error where n is 0 or successes are not from 0 to n."""
    z = z_of(confidence)
    s, m = successes.cast("double"), n.cast("double")
    p = s / m
    center, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    bad = (n <= 0) | (successes < 0) | (successes > n)
    value = F.struct(p.alias("point"), F.greatest(F.lit(0.0), (center - spread) / scale).alias("low"), F.least(F.lit(1.0), (center + spread) / scale).alias("high"), n.cast("long").alias("n"))
    return F.when(bad, F.raise_error(F.lit("successes must be from 0 to n, and n above 0"))).otherwise(value)


def wilson_or_null(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    return F.when(n > 0, wilson(successes, F.greatest(n, F.lit(1)), confidence))
