"""Sources and sinks: corpora, media listings, the Parquet index store, JSON-text interchange."""
