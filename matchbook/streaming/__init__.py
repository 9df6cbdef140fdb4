"""Structured Streaming jobs: search, ingest, and the operation log."""
