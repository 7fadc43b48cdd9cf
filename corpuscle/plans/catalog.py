"""All queries by name, with the SQL that checks them."""

from __future__ import annotations

from . import code_queries, corpus_queries, graph_queries, outline_queries, search_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
