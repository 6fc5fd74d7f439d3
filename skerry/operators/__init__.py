"""Operators that reshape, filter, join or summarise a DataFrame."""
