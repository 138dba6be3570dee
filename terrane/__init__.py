"""Spark-native analysis of complete combinatorial sequence tables."""
