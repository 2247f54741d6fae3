"""Spark-native quality engine for vector layers."""

__version__ = "0.1.0"
