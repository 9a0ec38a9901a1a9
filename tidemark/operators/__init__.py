"""Operators on long tables: one row a stored value, zeros implicit."""
