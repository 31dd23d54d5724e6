"""Spark-native analytics over long-lived agent memory."""
