"""plotweave: balanced graph partitioning of geographic units on Spark DataFrames."""

__version__ = "0.1.0"
