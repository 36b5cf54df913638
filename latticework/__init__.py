"""Structured matrices, point sets and experiment results as Spark DataFrames."""
