"""Operators over the logical tables: resolution, graph, selection, search, changes."""
