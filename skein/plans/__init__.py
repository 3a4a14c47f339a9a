"""Plans of the catalog jobs."""
