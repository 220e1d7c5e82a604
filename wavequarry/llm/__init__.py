"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this package.  ``queries.py`` holds the
driver-facing queries and their SQL; each operator has a module of its own.
"""
