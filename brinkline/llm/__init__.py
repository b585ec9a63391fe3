"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it.  Every operator takes a
DataFrame and column names, selects only the columns it needs (so extra or
clashing columns are harmless) and returns its own columns.
"""
