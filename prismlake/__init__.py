"""Spark-native analytics for media libraries: duplicates, metadata, organising plans."""
