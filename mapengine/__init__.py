"""Large map extracts as clean, queryable Spark tables."""
