"""Operators for preparing training text: deduplication, scanning, mixing, packing and search."""
