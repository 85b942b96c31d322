"""Spark-native hybrid retrieval and text analytics."""
