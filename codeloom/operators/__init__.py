"""Operators over a code graph. Each takes and returns DataFrames; only the facade collects."""
