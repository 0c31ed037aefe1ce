"""Operators for preparing language-model training data.

Nothing outside this folder imports it. ``catalog`` lists its queries and the
DuckDB statements that state the same results.
"""
