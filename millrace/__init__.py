"""Millrace: collection queries and document cleaning on Spark DataFrames."""

__version__ = "0.1.0"
