"""Operators for building training corpora at scale; nothing outside this folder imports it."""
