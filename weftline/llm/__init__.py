"""Operators for preparing training data, each a DataFrame-to-DataFrame function.

Nothing else in the repository imports this package; the queries over the standard
tables are in :mod:`llm.queries`.
"""
