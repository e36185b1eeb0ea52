"""folioforge: a Spark-native engine for searching and analysing document corpora."""

__version__ = "0.1.0"
