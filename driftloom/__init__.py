"""Spark-native analytics over conversation logs and text corpora."""
