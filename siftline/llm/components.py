"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _outward(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of the neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _inward(edges: DataFrame) -> DataFrame:
    """``u`` is the larger end: link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every linked node that isn't its component's smallest node, ``root``.

    ``a`` and ``b`` are long columns; a null end or a link of a node to itself counts as no link. The rounds,
    a logarithm of the longest path, go on until no link moves. No neighbourhood is gathered: each round is a grouped
    minimum and a join with one row per node, which splits where a node has very many links.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = written(ends.where(ends[2]).select("u", "v").where("u != v").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        edges = written(_inward(_outward(edges)).distinct(), "links")
