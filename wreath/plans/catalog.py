"""Collects every registered query. Importing a query module registers it."""

from __future__ import annotations

from wreath.plans import (  # noqa: F401
    queries_cohort,
    queries_core,
    queries_io,
    queries_linkage,
    queries_models,
    queries_nomination,
    queries_relational,
    queries_skew,
    queries_surface,
    queries_text,
    queries_topics,
    queries_vectors,
)
from wreath.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
