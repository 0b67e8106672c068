"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted

#: A node with this share of all links, or more, is joined by broadcast: there can be no more than twice as many of them.
HEAVY = 256


def _joined(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. The links of a heavy node stay where they are, so that no task gets them all."""
    heavy = F.broadcast(least.where(F.col("n") * HEAVY >= links).select("u", "m"))
    light = edges.join(heavy, "u", "left_anti").join(least.select("u", "m"), "u")
    return light.unionByName(edges.join(heavy, "u"))


def _outward(edges: DataFrame, links: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of the neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _joined(both, least, links).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _inward(edges: DataFrame, links: int) -> DataFrame:
    """``u`` is the larger end: link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _joined(edges, least, links).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every linked node that isn't its component's smallest node, ``root``.

    ``a`` and ``b`` are long columns; a null end or a link of a node to itself counts as no link. The rounds,
    a logarithm of the longest path, go on until no link moves. No neighbourhood is gathered: each round is a grouped
    minimum and a join with one row per node. Each round's links are written, so a lost executor costs one round at most.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = persisted(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        edges = persisted(_inward(_outward(edges, 2 * now[0]), now[0]).distinct(), "links")
