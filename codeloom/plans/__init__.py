"""Registered queries of the code-graph engine with their SQL."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
