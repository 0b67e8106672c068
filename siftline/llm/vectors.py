"""Shared by the vector operators: codebooks from bounded samples, and block joins of cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a cell that one task compares with as many others at a time.
BLOCK = 2048


def usable(vector: str) -> Column:
    """A vector that isn't null, empty or zero, and has finite components only."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def sample(rows: DataFrame, key: str, vector: str, size: int) -> np.ndarray:
    """At most ``size`` vectors, those with the smallest hashes of ``key``: the same ones in every run."""
    found = rows.select(vector, F.xxhash64(key).alias("_order"), F.col(key).alias("_key")).orderBy("_order", "_key").limit(size)
    return np.array([row[0] for row in found.collect()], float)


def codebook(points: np.ndarray, words: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm from distinct points; never more words than distinct points."""
    distinct = np.unique(points, axis=0)
    random = np.random.default_rng(seed)
    centres = distinct[random.permutation(len(distinct))[:words]]
    for _ in range(rounds):
        nearest = squared_distances(points, centres).argmin(axis=1)
        for word in range(len(centres)):
            own = points[nearest == word]
            if len(own):
                centres[word] = own.mean(axis=0)
    return np.unique(centres, axis=0)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def compare_cells(indexed: DataFrame, probes: DataFrame, cell: list[str], key: str, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                  schema: str, block: int = BLOCK) -> DataFrame:
    """``compare(indexed rows, probe rows)`` of each cell, whole and once for every pair of rows, in pieces of bounded size.

    A cell of any size is dealt into blocks of about ``block`` rows on both sides by the hash of ``key``; each block of the one side meets each
    block of the other in a group of its own, so that no task holds a whole cell. Both tables have the same columns.
    """
    def sizes(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(cell).agg(F.ceil(F.count("*") / block).alias(name))

    blocks = sizes(indexed, "_own").join(sizes(probes, "_other"), cell)
    number = F.pmod(F.xxhash64(key), "_own")
    left = indexed.join(blocks, cell).withColumn("_a", number).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
    mirrored = blocks.select(*cell, F.col("_other").alias("_own"), F.col("_own").alias("_other"))
    right = probes.join(mirrored, cell).withColumn("_b", number).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
    names = [name for name in indexed.columns if name not in cell]
    both = left.select(*cell, "_a", "_b", F.lit(True).alias("_indexed"), *names).unionByName(
        right.select(*cell, "_a", "_b", F.lit(False).alias("_indexed"), *names))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        side = group["_indexed"].to_numpy(bool)
        return compare(group[side], group[~side])

    return both.groupBy(*cell, "_a", "_b").applyInPandas(run, schema)
