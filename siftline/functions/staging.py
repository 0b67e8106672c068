"""Evaluate derived columns exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read but never re-compute.

    A plain projection is merged into its consumers, and a filter on one of its columns is pushed
    below it, so an expensive expression would run several times. The one-row generator stops both.
    """
    derived = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(derived)))
