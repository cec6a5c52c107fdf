"""Cluster-based recommendation analytics over (item, user, rating) data, as Spark DataFrames."""

__version__ = "0.1.0"
