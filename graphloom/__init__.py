"""Spark-native analytics over batches of three-dimensional graphs."""
