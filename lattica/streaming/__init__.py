"""Entities one at a time, and streams joined with tables."""
