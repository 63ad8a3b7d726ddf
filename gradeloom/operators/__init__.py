"""Operators on assessment tables: DataFrames and parameters in, a DataFrame out."""
