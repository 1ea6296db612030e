"""Rule tables: vocabularies of fixed values, and rewrite rules kept as data."""
