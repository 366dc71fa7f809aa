"""Operators for preparing training data: fingerprints, mixing, deduplication, search, packing, formatting, archives."""
