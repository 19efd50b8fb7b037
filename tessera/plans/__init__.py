"""Registered queries and the SQL that gives the same rows."""

from . import analysis, analytics, documents, index
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysis", "analytics", "documents", "index"]
