"""Confusion-matrix expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(truth: Column, predicted: Column) -> list[Column]:
    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return [
        count((truth == 1) & (predicted == 1), "tp"),
        count((truth == 0) & (predicted == 0), "tn"),
        count((truth == 0) & (predicted == 1), "fp"),
        count((truth == 1) & (predicted == 0), "fn"),
    ]


def rates() -> dict[str, Column]:
    """Rates from the columns ``tp``, ``tn``, ``fp`` and ``fn``."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(F.lit(2) * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
        "tnr": ratio(tn, tn + fp),
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
    }


def outcome(truth: Column, predicted: Column) -> Column:
    """``tp``, ``tn``, ``fp``, ``fn``, or ``unknown`` when either side is not 0 or 1."""
    return (
        F.when((truth == 1) & (predicted == 1), "tp")
        .when((truth == 0) & (predicted == 0), "tn")
        .when((truth == 0) & (predicted == 1), "fp")
        .when((truth == 1) & (predicted == 0), "fn")
        .otherwise("unknown")
    )
