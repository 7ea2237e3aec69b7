"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; it imports nothing from the rest of
the library, so that either side can be removed without breaking the other.
"""
