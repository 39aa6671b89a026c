"""Operators that a training-data pipeline needs, each a module of its own.

Nothing else in the library imports this subpackage.
"""
