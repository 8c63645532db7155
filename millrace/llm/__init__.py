"""Operators for training-data pipelines: tokenising, deduplication, filtering, mixing.

Nothing else in the library imports this subpackage.
"""
