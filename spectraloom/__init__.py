"""Spark-native analytics for radio-frequency recordings and embeddings."""
