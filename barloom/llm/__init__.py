"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator takes DataFrames and returns DataFrames; ``queries``
applies each to its whole table with production parameters.
"""
