"""Operators of a training-data pipeline: mixing, deduplication, filtering, search, sharding, packing."""
