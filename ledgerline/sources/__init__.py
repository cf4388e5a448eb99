"""Readers of files, and lines for writers."""
