"""Operators on graphs, edge multisets and document tables."""
