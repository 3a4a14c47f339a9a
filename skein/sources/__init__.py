"""Sources of the catalog jobs."""
