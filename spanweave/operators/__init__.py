"""Relational operators over whole libraries."""
