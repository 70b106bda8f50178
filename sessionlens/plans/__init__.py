"""Registered queries over the driver tables, and the SQL that checks them."""

from sessionlens.plans import event_queries, operator_queries, session_queries, text_queries  # noqa: F401
from sessionlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
