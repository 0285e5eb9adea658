"""Readers of source files: recognition, scene documents, binary containers."""
