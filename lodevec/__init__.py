"""Spark-native embedding analytics."""
