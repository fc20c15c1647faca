"""Quarry: a Spark-first retrieval and corpus-preparation engine."""

__version__ = "0.1.0"
