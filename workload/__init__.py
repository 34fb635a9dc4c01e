"""Queries over the benchmark tables, each with the SQL that must give the same rows."""
