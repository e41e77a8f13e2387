"""Structured Streaming jobs over rating messages."""
