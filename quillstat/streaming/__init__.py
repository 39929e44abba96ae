"""Structured Streaming versions of the ingest and time operators (STR1-STR5)."""
