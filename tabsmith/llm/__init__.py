"""Operators of a training-data pipeline over text tables.

Nothing else in the library imports this subpackage. ``catalog.QUERIES`` and
``oracle.ORACLE`` are what ``__spark_entry__`` adds when it can be imported.
"""
