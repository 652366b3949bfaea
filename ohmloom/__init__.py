"""Contextual time-series analytics on Spark."""
