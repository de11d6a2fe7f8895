"""Operators of a training-data pipeline over plain document tables.

Nothing else in the library imports this subpackage; it can be deleted.
"""
