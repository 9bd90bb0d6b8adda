"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries (``op1_`` to ``op10_`` and ``pipeline``) and their SQL.
"""
