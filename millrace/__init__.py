"""Millrace: a Spark-native data-movement and data-processing engine."""
