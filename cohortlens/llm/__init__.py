"""Operators for large training-data pipelines (secrets, dedup, search, packing ...)."""
