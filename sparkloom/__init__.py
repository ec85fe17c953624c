"""Spark-native catalog, search, validation and intake operators."""
