"""Spark-native analytics over fact graphs."""
