"""Spark-native analytics for image time-series cubes stored as tables."""
