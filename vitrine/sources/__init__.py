"""Sources and sinks: CSV, raw vector files, parquet (optional tables,
resumable appends), JSON review pages, JSON-safe records."""
