"""Spark-native analytics for long-distance trail data."""
