"""Cellwright: a Spark-native typed record store and analytics engine."""

__version__ = "0.1.0"
