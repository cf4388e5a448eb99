"""Structured Streaming over event records."""
