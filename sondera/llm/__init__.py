"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``queries`` has the thin query of each.
"""
