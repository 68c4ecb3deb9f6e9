"""Spark-native empirical-Bayes analytics for sparse entity x feature counts."""
