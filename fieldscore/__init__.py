"""Spark-native scoring of structured document extraction, and the data work around it."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
