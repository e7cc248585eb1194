"""Operators on DataFrames: training, prediction, ranking, evaluation."""
