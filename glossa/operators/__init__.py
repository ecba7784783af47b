"""Relational operators of the vocabulary review."""
