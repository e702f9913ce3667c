"""Structured Streaming ingest and keyed live state."""
