"""SimHash near-duplicates: fingerprints, block keys by the pigeonhole principle, verified bit distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import written

SEED = 42
BITS = 64
SLICE = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, width: int) -> int:
    """64 bits as a signed number; a bit is 1 if more than half of all shingle hashes have it."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[end + 1 for end in ends]]
    shingles = [line[a:b] for a, b in zip(starts, ends[width - 1:])] or [line]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SLICE):
        octets = hashes[at:at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x or b"", width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _block_keys(distance: int) -> Column:
    """Array of (part, value): ``distance`` + 2 blocks of bits, every two of them a key.

    Prints that differ in at most ``distance`` bits are equal in at least two blocks.
    """
    blocks = distance + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    both = [a | b for a, b in combinations(masks, 2)]
    return F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
                     for i, m in enumerate(both)])


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(prints: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Links (fp, other) between distinct prints that connect all prints within ``distance`` bits.

    Prints are joined on their block keys and verified. In a key of more than ``crowd`` prints no pairs are made:
    all prints of such keys are given the prints at most ``distance`` / 2 bits away as centres. Two prints share a centre
    only if they are within ``distance``, and always if they are, so each is linked to the smallest print of its
    centre: as many rows as prints times a constant, and no link between components is lost.
    """
    if distance < 0 or distance % 2:
        raise ValueError("distance must be an even number of bits")
    keyed = prints.select("fp", F.inline(_block_keys(distance)))
    sizes = keyed.groupBy("part", "value").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(sizes, ["part", "value"]), "blocks")
    sparse = keyed.where(F.col("n") <= crowd)
    pairs = sparse.join(sparse.select("part", "value", F.col("fp").alias("other")), ["part", "value"])
    pairs = pairs.where(F.col("fp") > F.col("other")).select("fp", "other")
    radius = distance // 2
    flips = [reduce(lambda m, bit: m | 1 << bit, bits, 0) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    crowded = keyed.where(F.col("n") > crowd).select("fp").distinct()
    around = F.explode(F.array(*[F.lit(_signed(m)) for m in flips]))
    balls = crowded.select("fp", around.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("other"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(least, "centre").where("fp != other").select("fp", "other")
    return pairs.unionByName(stars).where(_distance("fp", "other") <= distance).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits, zero for texts without words (null ones too), which are linked like
    any other. ``component_id`` is the smallest id reachable over links of at most ``distance`` bits; rows that
    repeat an id are one document. A row with a null id links nothing and its component is null.
    """
    found = written(fingerprints(docs, width, doc_id, text), "prints")
    first = written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    linked = links(first, distance).join(first.select("fp", F.col("first").alias("a")), "fp")
    linked = linked.join(first.select(F.col("fp").alias("other"), F.col("first").alias("b")), "other").select("a", "b")
    # an id on several rows is one node, whatever its prints
    same = found.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("doc_id")
    same = found.join(same, "doc_id").join(first, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    roots = components(linked.unionByName(same), "a", "b")
    classes = first.join(roots, F.col("first") == F.col("node"), "left")
    classes = classes.select("fp", F.coalesce("root", "first").alias("component_id"))
    result = found.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return result
