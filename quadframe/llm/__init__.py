"""Operators for training-data pipelines: filters, deduplication, search, mixing and packing."""
