"""All registered queries and their SQL."""

from __future__ import annotations

from wavespan.functions import applied_queries, state_queries
from wavespan.plans import file_queries, library_queries, recording_queries


def queries() -> dict:
    return {name: f for name, (f, _) in recording_queries.REGISTRY.items()} | library_queries.queries() | applied_queries.queries() | state_queries.queries() | file_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in recording_queries.REGISTRY.items() if sql} | library_queries.oracle_sql() | applied_queries.oracle_sql() | state_queries.oracle_sql() | file_queries.oracle_sql()
