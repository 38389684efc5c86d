"""Hashing, pacing and payload functions."""
