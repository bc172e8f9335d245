"""Spark-native engine for SQL over delimited text and Parquet."""

__version__ = "0.1.0"
