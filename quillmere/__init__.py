"""Spark-native shape, distance and embedding analytics."""
