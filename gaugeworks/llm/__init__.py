"""Operators for large text corpora: sharding, secrets, packing, deduplication, quality, search, tokens."""
