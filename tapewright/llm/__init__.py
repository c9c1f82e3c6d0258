"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; its queries and their SQL
live in ``queries.py``.  Every operator takes and returns DataFrames.
"""
