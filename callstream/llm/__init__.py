"""Operators that prepare training data: see the table in the README."""
