"""Operators for preparing large text corpora; see ``queries.py`` for the registered queries."""
