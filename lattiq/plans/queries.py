"""All registered queries of the offering engine."""

from __future__ import annotations

from lattiq.plans import build_queries, catalog_queries, event_queries, participant_queries, store_queries, text_queries  # noqa: F401  (they register their queries)
from lattiq.plans.bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
