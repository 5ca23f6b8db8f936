"""Operators on DataFrames: blocking, comparing, scoring, clustering, evaluating."""
