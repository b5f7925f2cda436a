"""Structured Streaming entry points (incremental early-warning scoring)."""
