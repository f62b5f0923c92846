"""Spark-native SQL analytics engine."""
