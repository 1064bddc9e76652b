"""Semantic code-context analytics on Spark DataFrames."""
