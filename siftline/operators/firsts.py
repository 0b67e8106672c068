"""First-per-key helpers that combine on the map side, so one hot key never fills one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: Column | str = "ord", last: bool = False) -> DataFrame:
    """The row with the smallest (or largest) ``order`` of every key.

    A grouped ``min_by`` keeps one row per key and map task before the shuffle; a window would send
    and sort every row of a hot key in one task.
    """
    order = F.col(order) if isinstance(order, str) else order
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.groupBy(*[F.col(k).alias(f"_group_{i}") for i, k in enumerate(keys)])
            .agg(pick(row, order).alias("_row")).select("_row.*"))


def visit_once(df: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """The first row per canonical address."""
    from ..functions.urls import canonical_url

    keyed = df.withColumn("url_key", canonical_url(F.col(url)))
    return first_per_key(keyed, ["url_key"], order)
