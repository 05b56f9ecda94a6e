"""All registered queries."""

from tokenloom.plans import text_queries, vector_queries
from tokenloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "text_queries", "vector_queries"]
