"""DataFrame operators: normalisation, validation, duplicates, versions, queries, statistics and operations."""
