"""Incremental ingest with Structured Streaming, and the edition calendar."""
