"""Spark-native document recall, protection and corpus-preparation engine."""

__all__ = ["__version__"]
__version__ = "0.1.0"
