"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from . import detector_queries, evidence_queries, rank_queries, routing_queries, session_queries, signal_queries, state_queries, timeline_queries

MODULES = (timeline_queries, detector_queries, rank_queries, session_queries, routing_queries, signal_queries, state_queries, evidence_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
