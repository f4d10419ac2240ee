"""Compositions of operators: index building, search, ingest."""
