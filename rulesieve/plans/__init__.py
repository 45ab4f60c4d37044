"""Queries over the given tables, put together from the operators."""
