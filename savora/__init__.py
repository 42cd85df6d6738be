"""Spark-native analytics over noisy public mentions, and training-data operators."""
