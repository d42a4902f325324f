"""Queries over the test tables, each with the SQL that checks it."""

from . import documents, governance, indicators, reviews, selection, series, signals, simulation, trades  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
