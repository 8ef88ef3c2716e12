"""Exponential-family graph models on Spark DataFrames."""
