"""Lexiquarry: document analytics expressed as Spark DataFrames and SQL."""

__version__ = "0.1.0"
