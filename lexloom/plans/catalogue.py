"""All queries of the library with their SQL."""

from __future__ import annotations

from . import application, base, indexes, relational, retrieval, text_queries, timed  # noqa: F401  registers the queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
