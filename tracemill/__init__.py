"""Spark-native analytics for language-model reasoning traces."""
