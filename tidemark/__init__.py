"""Tidemark: a PySpark-native engine for time-series analytics and corpus preparation."""

from tidemark.runtime import ship_by_value

__version__ = "0.1.0"

ship_by_value()
