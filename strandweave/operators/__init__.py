"""Relational operators of the mapping engine."""
