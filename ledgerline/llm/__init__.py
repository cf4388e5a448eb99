"""Training-data operators: scoring, deduplication, extraction, mixing, packing, scans and counts.

Nothing else in the library imports this subpackage.
"""
