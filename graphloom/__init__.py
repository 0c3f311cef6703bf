"""Spark-native analytics over document graphs."""
