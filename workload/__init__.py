"""Queries over the given tables, each with the same result stated in SQL."""
