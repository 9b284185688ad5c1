"""Queries, entity folding and the write side."""
