"""Byte-level BPE over Arrow batches: encode with character offsets, decode by the reversed byte table."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from .tokenizing import byte_encoder


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


ROWS = 1000  # worked on at a time


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", offsets: bool = True,
           packed: bool = False) -> DataFrame:
    """(doc_id, ids[, starts, ends]) of every row of ``docs``.

    ``ranks`` is the place of the rank file on every executor. No special tokens: their strings are ordinary text. A null
    or empty text has no ids. ``ids`` are an array, or if ``packed`` little-endian unsigned 32-bit numbers in a binary value.
    ``starts`` and ``ends`` count characters; a token that holds only part of a character's bytes covers that character.
    """
    names = ["doc_id", "ids", "starts", "ends"][:4 if offsets else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern)
        for batch in _slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            data = list(encoder.encode(texts))
            ids = [np.frombuffer(x, "<u4") for x in data]
            columns = [batch.column(0), pa.array(data, pa.binary()) if packed else _lists(ids)]
            if offsets:
                pairs = [encoder.offsets(x, i) for x, i in zip(texts, ids)]
                columns += [_lists([p[k] for p in pairs]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {"doc_id": "long", "ids": "binary" if packed else "array<int>"}
    schema = ", ".join(f"{name} {kinds.get(name, 'array<int>')}" for name in names)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", with_text: bool = True) -> DataFrame:
    """``rows`` with ``decoded`` (the bytes) and, ``with_text``, ``decoded_text``; ``ids`` as ``encode`` gives them.

    Ids may end within a character; in the text, bytes that form no character become U+FFFD. Null ids give nulls, an
    unknown id an error.
    """
    others = [name for name in rows.columns if name not in ("decoded", "decoded_text")]
    at = others.index(ids)
    packed = isinstance(rows.schema[ids].dataType, BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern)
        for batch in _slices(batches):
            known = (x if x is None else np.frombuffer(x, "<u4") if packed else np.asarray(x, np.int64) for x in batch.column(at).to_pylist())
            data = [None if x is None else encoder.decode(x) for x in known]
            columns = [*batch.columns, pa.array(data, pa.binary())]
            if with_text:
                columns.append(pa.array([None if x is None else x.decode("utf-8", "replace") for x in data], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*others, "decoded", "decoded_text"][:len(columns)])

    schema = StructType([rows.schema[name] for name in others]).add("decoded", BinaryType())
    return rows.select(*others).mapInArrow(run, schema.add("decoded_text", StringType()) if with_text else schema)


def decode_pieces(rows: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", start: str = "start",
                  ids: str = "ids") -> DataFrame:
    """(doc_id, start, text) of documents cut into pieces, as by packing: a character whose bytes lie in
    two pieces belongs to the later one, so that the texts in order make up the whole text.

    The pieces of a document are streamed in order through one decoder; only bytes of one character are carried. Bytes that
    end the document within a character become U+FFFD in a last row with a null ``start``. A null array is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern)
        pieces = (piece for batch in batches for piece in zip(*(column.to_pylist() for column in batch.columns)))
        for key, own in groupby(pieces, key=lambda piece: piece[0]):
            decoder, out = codecs.getincrementaldecoder("utf-8")("replace"), []
            for _, at, tokens in own:
                out.append((at, decoder.decode(encoder.decode(np.asarray(tokens or [], np.int64)))))
                if len(out) >= 1000:
                    yield _piece_batch(key, out)
                    out = []
            if rest := decoder.decode(b"", True):
                out.append((None, rest))
            yield _piece_batch(key, out)

    ordered = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(start).cast("long").alias("start"), F.col(ids).alias("ids"))
    ordered = ordered.repartition("doc_id").sortWithinPartitions("doc_id", "start")
    return ordered.mapInArrow(run, "doc_id long, start long, text string")


def _piece_batch(key: int | None, pieces: list[tuple[int | None, str]]) -> pa.RecordBatch:
    starts, texts = zip(*pieces) if pieces else ((), ())
    return pa.RecordBatch.from_arrays([pa.array([key] * len(pieces), pa.int64()), pa.array(starts, pa.int64()),
                                       pa.array(texts, pa.string())], ["doc_id", "start", "text"])

