"""Sum-of-squares packing: documents go, in the order they come, to windows of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizing import word_encoder

Piece = tuple  # (document, first id within it, ids)
FLUSH = 512  # sequences a batch returns
NONE = 1 << 62  # of a level without a window
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")


class Packer:
    """Open windows by fill level.

    ``levels[h]`` counts the windows with ``h`` tokens. A piece of ``n`` tokens goes to a level (0: a new window) that
    leaves the sum of squared counts smallest; a window that becomes full is closed and counts no more.
    """

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.into = np.zeros(size + 1, np.int64)  # what a window more changes the sum by, less 1
        self.out = np.full(size + 1, NONE)  # what a window less changes it by, less 1
        self.into[size] = self.out[0] = -1
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.closed: list[list[Piece]] = []

    def place(self, piece: Piece) -> None:
        n = len(piece[2])
        if n == self.size:
            self.closed.append([piece])
            return
        # Taking a window from level h changes the sum by 1 - 2 counts, putting it on h + n by 1 + 2 counts. Both ones
        # are left out, but for a new window, which is taken from no level, and a full one, which is put on none.
        change = self.into[n:] + self.out[:self.size - n + 1]
        level = int(change.argmin())
        if level:
            window = self.windows[level].pop()
            self._count(level, -1)
        else:
            window = []
        window.append(piece)
        if level + n == self.size:
            self.closed.append(window)
        else:
            self.windows[level + n].append(window)
            self._count(level + n, 1)

    def _count(self, level: int, more: int) -> None:
        count = int(self.levels[level]) + more
        self.levels[level], self.into[level], self.out[level] = count, 2 * count, -2 * count if count else NONE

    def finish(self) -> None:
        """Fill the windows still open by cutting up the emptiest of them; what is left over fills windows of powers of two."""
        left = [(level, window) for level in range(self.size) for window in self.windows[level]]
        self.levels[:], self.into[:-1], self.out[1:], self.windows = 0, 0, NONE, [[] for _ in range(self.size)]
        spare: list[Piece] = []  # a stack of pieces taken out of the emptiest windows
        low, high = 0, len(left) - 1
        while low <= high:
            level, window = left[high]
            high -= 1
            need = self.size - level
            while need and (spare or low <= high):
                if not spare:
                    spare = left[low][1][::-1]
                    low += 1
                need -= self._move(spare, window, need)
            if not need:
                self.closed.append(window)
            else:
                spare = window[::-1]
        rest = sum(len(piece[2]) for piece in spare)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                room -= self._move(spare, window, room)
            self.closed.append(window)

    @staticmethod
    def _move(spare: list[Piece], window: list[Piece], need: int) -> int:
        document, start, ids = spare.pop()
        if len(ids) > need:
            spare.append((document, start + need, ids[need:]))
            ids = ids[:need]
        window.append((document, start, ids))
        return len(ids)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in the document (``start``, ``length``) and in its sequence
    (``sequence_id``, ``offset``); ``ids_crc32`` of its ids as little-endian unsigned 32-bit numbers, and with
    ``with_ids`` the ids themselves.

    A document is its ids and then ``end_id`` (of a null or empty text, ``end_id`` alone). Each task packs its own
    documents: whole windows are cut off the front of a long one, the rest is placed by sum of squares, and at the end the
    open windows are filled up by cutting. Of all sequences only the last few of a task are shorter than ``size``, by
    powers of two, so none needs padding. Rows that repeat a document, or have no id, are documents of their own.
    Numbers of sequences are unique, not consecutive. A task that is run again gives the same rows.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(tokenizer), Packer(size)
        number = TaskContext.get().partitionId() << 33
        eos = np.array([end_id], "<u4")

        def rows(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            if not everything and len(packer.closed) < FLUSH:
                return
            out, arrays = [], []
            for window in packer.closed:
                offset, total = 0, sum(len(ids) for _, _, ids in window)
                for (key, tokens), start, ids in window:
                    out.append((key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, number, offset, total))
                    arrays.append(ids)
                    offset += len(ids)
                number += 1
            packer.closed = []
            if not out:
                return
            columns = [pa.array(column, pa.int64()) for column in zip(*out)]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in arrays], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = (x or "" for x in batch.column(1).to_pylist())
            for key, data in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                ids = np.concatenate([np.frombuffer(data, "<u4"), eos])
                for start in range(0, len(ids), size):
                    packer.place(((key, len(ids)), start, ids[start:start + size]))
                yield from rows(False)
        packer.finish()
        yield from rows(True)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)
