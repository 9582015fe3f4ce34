"""All core queries and their SQL."""

from __future__ import annotations

from scriptoria.plans import base_plans, orphan_plans, quality_plans, retrieval_plans, search_plans, store_plans

MODULES = [orphan_plans, retrieval_plans, search_plans, base_plans, quality_plans, store_plans]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
