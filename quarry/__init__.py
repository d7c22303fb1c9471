"""Structured information extraction from web pages on Spark DataFrames."""

__version__ = "0.1.0"
