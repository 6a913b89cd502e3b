"""lodestack: a Spark-native engine for indexing, searching and preparing text collections."""

__version__ = "0.1.0"
