"""Spark-first retrieval, code-graph and corpus-maintenance engine."""

__version__ = "0.1.0"
