"""Spark-native annotation, pair-mining and evaluation engine."""
