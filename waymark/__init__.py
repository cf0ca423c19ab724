"""Spark-native place data, batch geocoding and training-data operators."""
