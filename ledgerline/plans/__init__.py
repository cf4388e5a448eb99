"""Guarded statements."""
