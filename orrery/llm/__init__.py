"""Operators for large training corpora, and the queries that apply them to the driver's tables.

Nothing outside this subpackage imports it: the rest of the library works with it deleted.
"""
