"""Spark-native assembly, chunking and hybrid retrieval for page-oriented document collections."""

__version__ = "0.1.0"
