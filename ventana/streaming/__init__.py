"""Structured Streaming versions of the ingest and daily operators."""
