"""Spark-native research and validation of rule-based signals on bar data."""
