"""lodestar: review analytics, retrieval and ranking on Spark DataFrames."""

__version__ = "0.1.0"
