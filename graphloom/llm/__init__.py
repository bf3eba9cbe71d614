"""Operators for training-data pipelines over very large text tables.

Nothing else in the library imports this subpackage.
"""
