"""Retail metrics and document evidence on Spark DataFrames."""
