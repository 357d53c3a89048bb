"""All queries of the roster jobs."""

from __future__ import annotations

from . import audit_queries, change_queries, check_queries, more_queries, operator_queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audit_queries", "change_queries", "check_queries", "more_queries", "operator_queries"]
