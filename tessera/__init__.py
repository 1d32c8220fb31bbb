"""Spark-native analytics for monthly panels of geographic units."""
