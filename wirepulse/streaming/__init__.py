"""Structured Streaming forms of ingestion, detection and result refresh."""
