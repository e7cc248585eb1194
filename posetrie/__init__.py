"""Spark-native index of labelled body poses."""
