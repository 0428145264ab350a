"""Structured Streaming forms of the queue-like flows."""
