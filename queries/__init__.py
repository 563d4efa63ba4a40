"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can say it."""

from queries.base import REGISTRY
from queries import clause_queries, kb_queries, review_queries, search_queries, source_queries, text_queries  # noqa: F401

__all__ = ["REGISTRY"]
