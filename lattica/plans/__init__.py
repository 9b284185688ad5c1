"""Shapes and their compilation to plans."""
