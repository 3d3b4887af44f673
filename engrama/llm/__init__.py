"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` holds its
driver queries and ``oracle.py`` their SQL.
"""
