"""Operators for training-data pipelines: sharding, deduplication, filtering, packing and formatting.

Nothing outside this subpackage imports it.
"""
