"""Registered queries; importing this package registers all of them."""

from scriptorium.plans import gap_queries, graph_queries, io_queries, library_queries, record_queries, text_queries
from scriptorium.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "gap_queries", "graph_queries", "io_queries", "library_queries", "record_queries", "text_queries"]
