"""Logical tables over the source tables."""
