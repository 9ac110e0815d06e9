"""All registered queries; importing this module registers them."""

from __future__ import annotations

from tessella.plans import colour_queries, page_queries, region_queries, shape_queries  # noqa: F401
from tessella.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
