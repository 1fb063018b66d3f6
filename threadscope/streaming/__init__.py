"""Structured Streaming entry points (stateless enrichment on a stream)."""
