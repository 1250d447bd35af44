"""The engine's queries, by name, with SQL twins for checking them."""

from __future__ import annotations

from quernal.plans import driver_queries, entity_queries, retrieval_queries, text_queries, web_queries
from quernal.plans.registry import Query

_REGISTERS = [m.register for m in (text_queries, web_queries, entity_queries, retrieval_queries, driver_queries)]


def queries() -> dict[str, Query]:
    return {name: f for r in _REGISTERS for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _REGISTERS for name, sql in r.sql.items()}
