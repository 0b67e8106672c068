"""DuckDB twins of the registered queries, written against the driver's tables."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    from . import flow, scalar, sources

    return {**scalar.SQL, **sources.SQL, **flow.SQL}
