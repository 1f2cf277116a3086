"""Spark-native planning of urban air-logistics networks."""
