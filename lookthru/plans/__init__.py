"""Views over the given tables, the query catalog and whole-pipeline jobs."""
