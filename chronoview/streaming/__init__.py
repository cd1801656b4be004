"""Structured Streaming forms of incremental work."""
