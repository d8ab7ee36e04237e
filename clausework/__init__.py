"""Spark-native text, retrieval and quality-analytics operators."""

__version__ = "0.1.0"
