"""Typed predicates and scalar functions."""
