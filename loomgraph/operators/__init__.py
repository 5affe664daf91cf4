"""Operators over the code graph: DataFrames in, DataFrames out."""
