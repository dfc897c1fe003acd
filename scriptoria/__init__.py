"""Spark-native scans, stores and training-data operators over documents."""
