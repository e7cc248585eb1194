"""Accuracy and confusion of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

UNKNOWN = "__unknown__"


def accuracy(predicted: DataFrame) -> DataFrame:
    """One row (total, correct, accuracy) of predictions (expected, predicted); equal nulls count as right, no rows as 0."""
    sums = predicted.agg(F.count(F.lit(1)).cast("double").alias("total"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).cast("double").alias("correct"))
    return sums.select("total", "correct", F.coalesce(F.col("correct") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)).alias("accuracy"))


def confusion(predicted: DataFrame) -> DataFrame:
    """(expected, predicted, n); null and empty predictions are __unknown__."""
    said = F.coalesce(F.nullif(F.col("predicted"), F.lit("")), F.lit(UNKNOWN)).alias("predicted")
    return predicted.select("expected", said).groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_maps(matrix: DataFrame) -> DataFrame:
    """(expected, predictions) with a map of counts by prediction."""
    return matrix.groupBy("expected").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted", "n")))).alias("predictions"))
