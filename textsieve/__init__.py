"""Approximate text search and text processing on Spark DataFrames."""
