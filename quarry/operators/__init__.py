"""Operators over DataFrames: chunking, search, catalog, metrics."""
