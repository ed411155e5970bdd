"""Spark-native procurement analytics: DataFrame operators over captured notices."""
