"""Registered queries over the given tables."""

from paperloom.plans import vector_queries, catalog_queries, text_queries, message_queries, metric_queries, learn_queries, stream_queries  # noqa: F401
from paperloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
