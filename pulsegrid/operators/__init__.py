"""Operators: DataFrames in, DataFrame out; the current time is an argument."""
