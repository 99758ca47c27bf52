"""Registered queries of the core, each with its equal in SQL where there is one."""

from __future__ import annotations

from lectern.plans import building, lanes, relational, retrieval, text  # noqa: F401  they register their queries
from lectern.plans.base import QUERIES, SQL

FLAGSHIP = "r_funnel"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
