"""Operators that prepare text for training: deduplication, mixing, filters, packing."""
