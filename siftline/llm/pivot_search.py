"""Exact search for the highest inner products by distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .vectors import codebook, compare_cells, sample, squared_distances


def _lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """One more component, so that near means a high inner product: |q - x|^2 = |q|^2 + most - 2 q.x for any two."""
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))
    return np.c_[x, last]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the ``k`` best candidates of each row, ties to the smaller id; candidates in the order of ids."""
    k = min(k, scores.shape[1])
    return [row[:k] for row in np.argsort(-scores, axis=1, kind="stable")]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, rings: int = 8, sample_size: int = 4096,
          vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` other rows of highest inner product (fewer, if there are
    fewer), ties to the smaller id.

    Every row is keyed by its nearest pivot and the distance to it; the distances of a pivot are cut into ``rings``.
    Pivots and ring edges come from at most ``sample_size`` rows, what the rings really hold from all rows. A query first
    searches the ring it falls into, which bounds its k-th best distance; then it walks the rings of each pivot outward from its own
    distance, and stops on either side at the first that the triangle inequality excludes.

    Components must be finite and whole sums exact in double precision for exact ties. Rows with a null id or vector, null
    or non-finite components take no part. Rows that repeat an id are one vector, of which the least is taken. Vectors of
    different lengths have no inner product: each length that has queries is searched by itself.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"), is_query.alias("query"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where("vec_id is not null and x is not null").where(finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("x", "query")).alias("v")).select("vec_id", "v.*")
    rows = written(rows, "vectors")
    widths = sorted(r[0] for r in rows.where("query").select(F.size("x")).distinct().collect())
    if not widths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_top_k_of_one_length(rows.where(F.size("x") == width), k, pivots, rings, sample_size) for width in widths]
    return reduce(DataFrame.unionByName, found)


def _top_k_of_one_length(rows: DataFrame, k: int, pivots: int, rings: int, sample_size: int) -> DataFrame:
    """``top_k`` of (vec_id, x, query) rows whose vectors are equally long."""
    norm = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    most = rows.agg(F.max(norm)).first()[0]
    points = _lifted(sample(rows, "vec_id", "x", sample_size), most, False)
    centres = codebook(points, pivots)
    distances = np.sqrt(squared_distances(points, centres))
    nearest = distances.argmin(axis=1)
    steps = np.linspace(0, 1, rings + 1)[1:-1]
    edges = np.stack([np.quantile(own, steps) if len(own := distances[nearest == p, p]) else np.zeros(rings - 1)
                      for p in range(len(centres))])

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = np.sqrt(squared_distances(_lifted(np.stack(batch["x"]), most, False), centres))
                pivot = far.argmin(axis=1)
                own = far[np.arange(len(far)), pivot]
                ring = (own[:, None] >= edges[pivot]).sum(axis=1)
                yield batch.assign(cell=pivot * rings + ring, distance=own)

    keyed = written(rows.mapInPandas(key, "vec_id long, x array<double>, query boolean, cell int, distance double"), "keyed")
    annuli = keyed.groupBy("cell").agg(F.min("distance"), F.max("distance")).toPandas().to_numpy()  # one row per ring at most
    inner, outer = np.full(len(centres) * rings, np.inf), np.full(len(centres) * rings, -np.inf)
    inner[annuli[:, 0].astype(int)], outer[annuli[:, 0].astype(int)] = annuli[:, 1], annuli[:, 2]
    inner, outer = inner.reshape(-1, rings), outer.reshape(-1, rings)

    def gaps(x: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to the rows of each ring."""
        far = np.sqrt(squared_distances(_lifted(x, most, True), centres))[:, :, None]
        return np.maximum(np.maximum(inner - far, far - outer), 0)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=gaps(np.stack(batch["x"])).reshape(len(batch), -1).argmin(axis=1))

    def compare(index: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(probe):
            index = index.sort_values("vec_id")
            x, ids = np.stack(index["x"]), index["vec_id"].to_numpy()
            for at in range(0, len(probe), 256):
                own = probe.iloc[at:at + 256]
                scores = np.stack(own["x"]) @ x.T
                queries = own["vec_id"].to_numpy()
                scores[queries[:, None] == ids[None, :]] = -np.inf
                for query, row, places in zip(queries.tolist(), scores, _best(scores, ids, k)):
                    out += [(query, int(ids[p]), float(row[p])) for p in places if row[p] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    schema = "query_id long, vec_id long, score double"
    indexed = keyed.select("cell", "vec_id", "x")
    queries = keyed.where("query").select("vec_id", "x")
    probed = queries.mapInPandas(first, "vec_id long, x array<double>, cell int").select("cell", "vec_id", "x")
    near = compare_cells(indexed, probed, ["cell"], "vec_id", compare, schema)
    # the k-th best score so far of each query; none, if the ring holds fewer
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bound = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"])
            bounds = batch["bound"].fillna(-np.inf).to_numpy()
            # no farther than the k-th best so far; a little more, for rounding
            reach = np.sqrt(np.maximum((x * x).sum(axis=1) + most - 2 * bounds, 0)) * (1 + 1e-9) + 1e-6
            far, near = np.sqrt(squared_distances(_lifted(x, most, True), centres)), gaps(x)
            cells = []
            for query in range(len(x)):
                own = []
                for pivot in range(len(centres)):
                    at = int((far[query, pivot] >= edges[pivot]).sum())
                    for side in (range(at, -1, -1), range(at + 1, rings)):
                        for ring in side:
                            if inner[pivot, ring] == np.inf:
                                continue
                            if near[query, pivot, ring] > reach[query]:
                                if ring != at:
                                    break
                                continue
                            own.append(pivot * rings + ring)
                cells.append(own)
            yield batch.drop(columns="bound").assign(cells=cells)

    walked = queries.join(bound, "vec_id", "left").mapInPandas(walk, "vec_id long, x array<double>, cells array<int>")
    probes = written(walked.select(F.explode("cells").alias("cell"), "vec_id", "x"), "probes")
    found = compare_cells(indexed, probes, ["cell"], "vec_id", compare, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""
