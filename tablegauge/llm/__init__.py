"""Operators of a training-data pipeline: dedup, quality, mixing, packing, archives.

Nothing else in the library imports this package.
"""
