"""Operators over the graph tables."""
