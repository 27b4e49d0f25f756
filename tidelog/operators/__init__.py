"""Relational operators of the log store: validation, filters, scoring, block assignment, statistics."""
