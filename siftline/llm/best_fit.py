"""Best-fit-decreasing packing into token-id matrices ready for training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizing import word_encoder

SCHEMA = ("sequence_id long, n_tokens int, ids binary, cumulative_lengths array<int>, position_ids binary, "
          "doc_ids array<long>, starts array<long>")


class Capacities:
    """Open windows by free tokens, in a segment tree over 0 .. ``size``: counts of windows in each span."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        node = self.leaves + free
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, window) of the window with the least room that has ``need``, and forget it."""
        node, counts = self.leaves + need, self.counts
        while not counts[node]:  # up, to the next span on the right that holds a window
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:  # down, to its leftmost window
            node *= 2
            if not counts[node]:
                node += 1
        free = node - self.leaves
        self._change(free, -1)
        return free, self.windows[free].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Indices of the pieces of each window; longest pieces first, equal ones in the order given."""
    open_windows, windows = Capacities(size), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = open_windows.take(need)
        if found is None:
            found = size, len(windows)
            windows.append([])
        free, window = found
        windows[window].append(piece)
        if free > need:
            open_windows.add(free - need, window)
    return windows


def _as_binary(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes, without a copy."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix[0].nbytes
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def pack_matrices(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, pad_id: int = 0,
                  block_tokens: int = 1 << 22, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window: a row of the token-id matrix with what attention within documents needs.

    ``ids`` are ``size`` little-endian unsigned 32-bit numbers, ``n_tokens`` of them real, the rest ``pad_id``.
    ``cumulative_lengths`` are 0 and the ends of the segments. ``position_ids`` (unsigned 32-bit) count from 0 in every
    segment and in the padding. ``doc_ids`` and ``starts`` tell of which document a segment is, and where in its ids.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. A document over ``size`` is cut into
    pieces of ``size`` and a rest, without loss. Pieces are packed by best fit decreasing in blocks of about ``block_tokens``
    of one task, which bounds memory; a task that is run again gives the same rows. Rows that repeat an id are documents
    of their own. Numbers of sequences are unique, not consecutive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = word_encoder(tokenizer), TaskContext.get().partitionId() << 33
        eos, ramp = np.array([end_id], "<u4").tobytes(), np.arange(size, dtype="<u4")
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number, pieces, held
            lengths = np.fromiter((len(x[2]) for x in pieces), np.int64, len(pieces))
            windows = best_fit_decreasing(lengths, size)
            for at in range(0, len(windows), 256):
                some, doc_ids, starts, ends = windows[at:at + 256], [], [], []
                ids, positions = np.empty((len(some), size), "<u4"), np.empty((len(some), size), "<u4")
                for row, window in enumerate(some):
                    own, end = [pieces[i] for i in window], 0
                    ends.append([0])
                    for _, _, piece in own:
                        start, end = end, end + len(piece)
                        ids[row, start:end], positions[row, start:end] = piece, ramp[:len(piece)]
                        ends[-1].append(end)
                    ids[row, end:], positions[row, end:] = pad_id, ramp[:size - end]
                    doc_ids.append([x[0] for x in own])
                    starts.append([x[1] for x in own])
                numbers = pa.array(np.arange(number, number + len(some)))
                number += len(some)
                yield pa.RecordBatch.from_arrays(
                    [numbers, pa.array([x[-1] for x in ends], pa.int32()), _as_binary(ids), pa.array(ends, pa.list_(pa.int32())),
                     _as_binary(positions), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names)
            pieces, held = [], 0

        for batch in batches:
            texts = (x or "" for x in batch.column(1).to_pylist())
            for key, data in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                ids = np.frombuffer(data + eos, "<u4")
                for start in range(0, len(ids), size):
                    pieces.append((key, start, ids[start:start + size]))
                held += len(ids)
                if held >= block_tokens:
                    yield from rows()
        yield from rows()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, folder: str, rows_per_file: int = 65536) -> None:
    """Write the windows as Parquet with fixed-width binary rows, ``rows_per_file`` to a file at most."""
    packed.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
