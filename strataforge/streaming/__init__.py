"""Structured Streaming over the request log."""
