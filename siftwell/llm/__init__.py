"""Operators for large-scale training-data pipelines.

One module for each operator; ``queries`` holds the thin registered queries and
their SQL.  Nothing outside this subpackage imports it.
"""
