"""lexivault: a PySpark-native document search, indexing and corpus engine."""

__version__ = "0.1.0"
