"""Scalar, list, map, date and math functions as Column expressions."""
