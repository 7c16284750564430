"""Operators for large-scale training data: filtering, de-duplication, extraction, mixing, packing, search, sharding."""
