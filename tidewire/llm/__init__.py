"""Operators for large text corpora: counting, filtering, near-duplicate removal, packing."""
