"""Operators for preparing language-model training data, with their queries and SQL.

Nothing else in the library imports this package; it may be removed as a whole.
"""
