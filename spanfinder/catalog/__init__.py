"""Registered queries, grouped by area."""

from . import detail_queries, evaluation_queries, indexing_queries, library_queries, search_queries, streaming_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
