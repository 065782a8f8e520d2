"""Tidemark: a PySpark-native engine for point-in-time event studies and data processing."""

__version__ = "0.1.0"
