"""Operators on the log and on its coordination tables."""
