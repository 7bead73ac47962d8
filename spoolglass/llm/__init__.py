"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin registered queries.
"""
