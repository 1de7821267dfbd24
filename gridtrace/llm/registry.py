"""The queries and SQL of this subpackage."""

from __future__ import annotations

from gridtrace.llm import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict:
    return dict(_q.ORACLE_SQL)
