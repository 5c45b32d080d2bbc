"""Structured Streaming jobs (incremental review ingest)."""
