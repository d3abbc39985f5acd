"""Operators: series to series, series to edges, edges to edges."""
