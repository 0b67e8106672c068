"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flow_queries, scalar_queries, source_queries


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**scalar_queries.QUERIES, **source_queries.QUERIES, **flow_queries.QUERIES}
