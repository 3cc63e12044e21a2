"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from .queries import QUERIES, SQL, cleaning, loading, profiling, scalars, tables  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
