"""Operators of the catalog jobs."""
