"""Operators of a training-data pipeline: deduplication, filtering, search, tokenising, sharding and mixing.

Nothing else in the library imports this subpackage.
"""
