"""Spark-native analytics for archives of long spoken-content records."""
