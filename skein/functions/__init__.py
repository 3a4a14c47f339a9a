"""Functions of the catalog jobs."""
