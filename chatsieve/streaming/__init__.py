"""Structured Streaming entry points (incremental scoring of prediction files)."""
