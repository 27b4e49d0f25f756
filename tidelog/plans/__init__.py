"""Whole query plans: semantic queries with block pruning, and the status view."""
