"""Operators on DataFrames: search, fusion, refinement, chunking, catalog, evaluation."""
