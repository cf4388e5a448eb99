"""Lineage, comparison and log analytics over DataFrames."""
