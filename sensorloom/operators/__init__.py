"""Operators: every function takes and returns Spark DataFrames."""
