"""Structured Streaming forms of ingest, dedup, upsert and counting."""
