"""Operators for large-scale training-data pipelines.

The subpackage stands alone: nothing else in the library imports it.
"""
