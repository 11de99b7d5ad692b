"""Operators for building language-model training data from a table of documents.

Nothing else in the library imports this package. ``queries`` and ``oracles`` list what it registers.
"""
