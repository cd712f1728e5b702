"""Operators on texts, pages and vectors for preparing training data.

Text operators work on the library's parameter sets (``name``, ``description``
and whatever else a set carries); any table with a key and a text column can be
given by naming the two. Nothing else in the library imports this package.
"""
