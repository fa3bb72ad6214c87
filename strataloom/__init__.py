"""Spark-native indexing, retrieval and corpus analysis over source code and documents."""

__all__ = ["__version__"]
__version__ = "0.1.0"
