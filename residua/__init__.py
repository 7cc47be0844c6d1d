"""Spark-native engine for prospecting sequence records: clean, search, group, score, rank."""
__version__ = "0.2.0"
