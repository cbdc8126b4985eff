"""Incremental mapping."""
