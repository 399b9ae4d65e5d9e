"""Operators that prepare training data: mixing, extraction, cleaning, deduplication, search and sharding."""
