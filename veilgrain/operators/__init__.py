"""Operators: DataFrames and plain options in, DataFrame out."""
