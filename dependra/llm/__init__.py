"""Operators for large text and embedding corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries.py`` derives the contract queries.
"""
