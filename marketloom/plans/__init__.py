"""Registered queries of the market engine."""

from . import analytics, lists, sources, texts, upkeep  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
