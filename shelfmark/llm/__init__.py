"""Operators for preparing training data: cleaning, deduplication, tokens, packing and sharding."""
