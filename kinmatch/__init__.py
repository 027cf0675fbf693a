"""Spark-native record linkage: sources, text functions, blocking, pair features, scoring, assignment and evaluation."""
