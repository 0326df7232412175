"""Operators over sources and task state: DataFrames in, DataFrames out, with the time as an argument."""
