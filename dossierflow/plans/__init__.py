"""Registered queries and the steps of the pipeline."""

from . import added_queries, detail_queries, engine_queries, further_queries, last_queries, piece_queries, source_queries, text_queries, upkeep_queries, whole_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
