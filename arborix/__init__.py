"""Arborix: DataFrame operators for interval, graph and tree shaped data on Spark."""

__version__ = "0.1.0"
