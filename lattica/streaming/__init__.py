"""Structured Streaming forms of ingestion, status feeds and limits."""
