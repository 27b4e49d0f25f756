"""Operators for preparing training text at scale; nothing else in tidelog imports this package."""
