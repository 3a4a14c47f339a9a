"""Streaming of the catalog jobs."""
