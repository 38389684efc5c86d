"""Predicates and plans that several operators share."""
