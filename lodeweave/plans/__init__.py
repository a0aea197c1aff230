"""Registered queries and their SQL."""

from . import aggregates, graphs, joins, predicates, quality, sequences, sinks, state, texts, vectors
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "graphs", "joins", "predicates", "quality", "sequences", "sinks", "state", "texts", "vectors"]
