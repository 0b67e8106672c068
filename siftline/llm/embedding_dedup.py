"""Near-duplicate embeddings by an inverted multi-index over the halves of vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .components import components
from .tables import written
from .vectors import codebook, compare_cells, sample, squared_distances, usable


def visits(lower: tuple[np.ndarray, np.ndarray], reach: float) -> list[tuple[int, int]]:
    """Cells of the product grid, nearest first, up to squared distance ``reach``.

    ``lower`` has, for each half, the least squared distance of the vector to anything in each codeword's share. Both lists are
    sorted and walked together: a cell is taken from the queue only after its neighbours nearer by one step.
    """
    order = [np.argsort(x, kind="stable") for x in lower]
    a, b = (x[o].tolist() for x, o in zip(lower, order))
    queue, seen, found = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while queue:
        far, i, j = heapq.heappop(queue)
        if far > reach:
            break
        found.append((int(order[0][i]), int(order[1][j])))
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(a) and j < len(b) and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(queue, (a[i] + b[j], i, j))
    return found


def least_distances(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codeword of each row, least squared distance from each row to the share of every codeword).

    Whatever is nearer to another codeword lies beyond the plane midway between that one and the row's own.
    """
    squared = squared_distances(x, words)
    own = squared.argmin(axis=1)
    gap = np.sqrt(squared_distances(words, words))[own]
    beyond = (squared - np.take_along_axis(squared, own[:, None], axis=1)) / np.maximum(2 * gap, 1e-12)
    return own, np.maximum(beyond, 0) ** 2


def _stars(similar: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it reaches) of the rows and columns that ``similar`` connects to a smaller id."""
    of_rows, of_columns, most = rows.copy(), columns.copy(), np.iinfo(np.int64).max
    while True:
        before = of_rows.sum(), of_columns.sum()
        of_columns = np.minimum(of_columns, np.where(similar, of_rows[:, None], most).min(axis=0))
        of_rows = np.minimum(of_rows, np.where(similar, of_columns[None, :], most).min(axis=1))
        if before == (of_rows.sum(), of_columns.sum()):
            ids, least = np.r_[rows, columns], np.r_[of_rows, of_columns]
            return ids[ids != least], least[ids != least]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, codewords: int = 16, sample_size: int = 8192, vec_id: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``; rows link if their labels are equal and their cosine,
    in double precision, is at least ``threshold``.

    Codebooks of both halves of the unit vectors come from at most ``sample_size`` rows; every row is indexed in its
    cell and visits, nearest cell first, all cells that can hold a vector within reach. The bound is exact, so recall is 1.
    Equal vectors are indexed once and weigh as many. Pairs aren't written: a block of a cell gives counts, and links enough to
    connect what it connects.

    A row whose label is null, or whose vector is null, empty, zero or holds null or non-finite components, links with
    nothing; vectors of different lengths don't link. Rows that repeat a vec_id are one vector, of which the
    least is taken. A row with a null vec_id has no links and null for the component and ``kept``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"),
                          F.col(label).alias("label"))
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.*")
    good = one.where(F.col("label").isNotNull() & usable("x")).select(
        "vec_id", "label", F.transform("x", lambda x: x + F.lit(0.0)).alias("x"))
    classes = written(good.groupBy("label", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
                      .withColumn("width", F.size("x")), "classes")
    points = classes.where(F.col("width") == (classes.agg(F.mode("width")).first()[0] or 0))
    known = sample(points, "vec_id", "x", sample_size)
    if len(known):
        known /= np.linalg.norm(known, axis=1, keepdims=True)
        half = known.shape[1] // 2
        books = [codebook(known[:, :half], codewords), codebook(known[:, half:], codewords)]
    else:
        half, books = 0, []
    reach = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors with that cosine

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for width, own in batch.groupby("width"):
                x = np.stack(own["x"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if books and width == books[0].shape[1] + books[1].shape[1]:
                    halves = [least_distances(x[:, :half], books[0]), least_distances(x[:, half:], books[1])]
                    cells = [visits((a, b), reach) for a, b in zip(halves[0][1], halves[1][1])]
                    homes = list(zip(halves[0][0].tolist(), halves[1][0].tolist()))
                else:  # vectors of another length than most: one cell
                    homes = [(0, 0)] * len(own)
                    cells = [[(0, 0)]] * len(own)
                out.append(own.assign(home=[a * codewords + b for a, b in homes], cells=[[a * codewords + b for a, b in c] for c in cells]))
            if out:
                yield pd.concat(out)

    schema = StructType([*classes.schema.fields, StructField("home", IntegerType()), StructField("cells", ArrayType(IntegerType()))])
    placed = written(classes.mapInPandas(place, schema), "cells")
    columns = ["label", "width", "vec_id", "weight", "x"]
    indexed = placed.select(F.col("home").alias("cell"), *columns)
    probes = placed.select(F.explode("cells").alias("cell"), *columns)

    def compare(index: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(probe):
            return pd.DataFrame({"vec_id": [], "n": [], "other": []}).astype("int64")
        unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (np.stack(index["x"]), np.stack(probe["x"]))]
        index_ids, probe_ids = index["vec_id"].to_numpy(), probe["vec_id"].to_numpy()
        weights, counts, stars = index["weight"].to_numpy(), np.zeros(len(probe), np.int64), []
        for at in range(0, len(probe), 512):
            similar = unit[1][at:at + 512] @ unit[0].T >= threshold
            similar &= probe_ids[at:at + 512, None] != index_ids[None, :]
            counts[at:at + 512] = similar @ weights
            stars.append(_stars(similar, probe_ids[at:at + 512], index_ids))
        linked = np.flatnonzero(counts)
        ids, least = (np.concatenate(x) for x in zip(*stars))
        return pd.DataFrame({"vec_id": np.r_[probe_ids[linked], ids], "n": np.r_[counts[linked], np.zeros(len(ids), np.int64)],
                             "other": np.r_[probe_ids[linked], least]}).astype("int64")

    found = written(compare_cells(indexed, probes, ["label", "width", "cell"], "vec_id", compare, "vec_id long, n long, other long"), "found")
    roots = components(found.where("vec_id != other"), "vec_id", "other")
    totals = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    totals = classes.select("vec_id", "label", "x", "weight").join(totals, "vec_id", "left").join(
        roots, F.col("vec_id") == F.col("node"), "left").select(
        "label", "x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
        F.coalesce("root", "vec_id").alias("component"))
    linked = good.join(totals, ["label", "x"]).select("vec_id", "n", "component")
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(embedding, embedding) > 0
), links AS (
  SELECT a.vec_id, b.vec_id AS other FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM good
  UNION
  SELECT r.vec_id, l.other FROM reached r JOIN links l ON r.other = l.vec_id
), classes AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT vec_id, count(*) AS n FROM links GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN classes USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
