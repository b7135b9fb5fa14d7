"""Spark-native analytics over business documents and transactions."""
