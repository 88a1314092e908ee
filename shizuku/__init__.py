"""Spark-native analytics for long-format environmental and biodiversity monitoring data."""
