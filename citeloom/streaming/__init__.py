"""Structured Streaming queries over the event log."""
