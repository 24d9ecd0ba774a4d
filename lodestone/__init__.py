"""Retrieval and text analytics on Spark DataFrames."""
