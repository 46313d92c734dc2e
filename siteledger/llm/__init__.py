"""Operators for large training-data pipelines, each a job over Spark DataFrames."""
