"""From source files to nodes and edges."""

from .operator import extract, parse_files, resolve_edges

__all__ = ["extract", "parse_files", "resolve_edges"]
