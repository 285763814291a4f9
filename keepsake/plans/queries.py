"""Import every query module so that the registry is complete."""

from __future__ import annotations

from keepsake.plans import (q_catalog, q_enrich, q_merge, q_misc, q_payloads, q_records,  # noqa: F401
                            q_rules, q_search, q_sources)
from keepsake.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
