"""Spark-native text evidence and geographic coupling engine."""
