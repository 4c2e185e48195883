"""All queries on the driver's tables, with their SQL."""

from __future__ import annotations

from . import event_queries, route_queries, text_queries


def queries() -> dict:
    return {**event_queries.Q, **text_queries.Q, **route_queries.Q}


def oracle_sql() -> dict[str, str]:
    return {**event_queries.SQL, **text_queries.SQL, **route_queries.SQL}
