"""Registered queries over the graph tables."""

from . import search_queries, store_queries, text_queries, upkeep_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
