"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_tree import Bits
from .tables import discard, release, written
from .tokenizing import let_go

DIMENSIONS = 32
NONZERO = 4  # of an index vector, one in each part of it
WINDOW = 2  # neighbours on either side
FREQUENT = 1 << 17  # most frequent units whose vectors every executor has
HELD = 3 << 17  # units whose sums a task holds before it passes them on
PIECE = 1 << 18  # characters of a text that a task works on at a time, and eight times the words of several
TOKENS = 1 << 26  # words whose sums a task adds up at most, so that 32 bits do
MEMORY = 200_000  # words a task remembers before it forgets the less frequent half
FILTER = 27  # bits of a unit by which a task tells that it is there only once
MARKS = ".,;:!?*#$%&|"

_LETTERS = regex.compile(r"\p{L}+")
_SPACE = re.compile(r"\s")


def _hash(word: str, kind: int) -> int:
    """What a unit is known by: 64 bits, so that units are told apart in a corpus of any size."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), kind)


def _case(letters: str) -> str:
    return "a" if letters.islower() else "A" if letters.isupper() and len(letters) > 1 else "C"


def _marks(text: str) -> str:
    """What a text looks like: runs of small, large and mixed letters, of digits and of each other character."""
    marks = regex.sub(r"\p{N}+", "0", _LETTERS.sub(lambda m: _case(m[0]), text))
    return regex.sub(r"(.)\1+", r"\1+", marks)


def _new(numbers: np.ndarray, known: int) -> list[int]:
    """Where each number that isn't below ``known`` comes first, if they were given in the order they come."""
    highest = np.maximum.accumulate(np.r_[known - 1, numbers])
    return np.flatnonzero(highest[1:] > highest[:-1]).tolist()


class Units:
    """Words to numbers, each word with two units: the word in small letters, and its shape (of its own, where it repeats the word before).

    The units have numbers too, in the order they come; ``units`` holds them by number. New words are worked on many at a time.
    """

    REPEATED = _hash("", 2)

    def __init__(self):
        let_go()
        self.units = array("Q", [self.REPEATED])
        self.known: dict[int, int] = defaultdict(count(1).__next__, {self.REPEATED: 0})
        self.shapes: dict[str, int] = {}
        self.words: dict[str, int] = defaultdict(count().__next__)
        self.pairs = array("i")
        self.times = np.empty(0, np.int64)

    def _forget(self) -> None:
        """Of the words, all but the most frequent that came more than once, at most half of what is remembered."""
        again = np.flatnonzero(self.times > 1)
        kept = np.sort(again[np.argsort(-self.times[again], kind="stable")[:MEMORY // 2]])
        words = list(self.words)
        self.words = defaultdict(count(len(kept)).__next__, zip(map(words.__getitem__, kept.tolist()), range(len(kept))))
        self.pairs = array("i", np.array(self.pairs, np.int32).reshape(-1, 2)[kept].tobytes())
        self.times = self.times[kept]

    def _both(self, word: str) -> tuple[int, int]:
        """Both units."""
        (unit,), (shape,) = self._all([word])
        return unit, shape

    def _all(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Word units and shape units. Most words are letters with a few marks behind them."""
        letters = [word.rstrip(MARKS) for word in words]
        looks = [("a" if own.islower() else _case(own)) + word[len(own):] if own.isalpha() else word for own, word in zip(letters, words)]
        for at in [k for k, own in enumerate(letters) if not own.isalpha()]:
            letters[at] = "".join(_LETTERS.findall(words[at]))
        if len(self.shapes) > MEMORY // 4:
            self.shapes = {}
        for look in set(looks).difference(self.shapes):
            # a word that looks like a case with marks behind it is one of letters with marks behind them
            plain = look[0] in "aAC" and not look[1:].strip(MARKS)
            self.shapes[look] = _hash(look[0] + _marks(look[1:]) if plain else _marks(look), 1)
        digest = xxhash.xxh64_intdigest
        return [digest(own.lower().encode("utf-8", "surrogatepass"), 0) for own in letters], list(map(self.shapes.__getitem__, looks))

    def _learn(self, words: list[str]) -> None:
        """Give the units of words that are new, in the order of their numbers, numbers of their own."""
        units = list(chain.from_iterable(zip(*self._all(words))))
        numbers = np.fromiter(map(self.known.__getitem__, units), np.int32, len(units))
        self.pairs.frombytes(numbers.tobytes())
        self.units.extend([units[k] for k in _new(numbers, len(self.units))])

    def numbers(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the word units, numbers of the shape units, number of words of each list of words)."""
        if len(self.words) >= MEMORY:
            self._forget()
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat, old = list(chain.from_iterable(split)), len(self.words)
        at = np.fromiter(map(self.words.__getitem__, flat), np.int32, len(flat))
        if len(self.words) > old:
            self._learn([flat[k] for k in _new(at, old)])
        times = np.bincount(at, minlength=len(self.words))
        times[:old] += self.times
        self.times = times
        words, shapes = np.frombuffer(self.pairs, np.int32).reshape(-1, 2).T if len(self.pairs) else np.empty((2, 0), np.int32)
        words, shapes = words[at], shapes[at]
        same = np.zeros(len(at), bool)
        same[1:] = (words[1:] == words[:-1]) & (shapes[1:] == shapes[:-1])
        starts = np.cumsum(lengths)[:-1]
        same[starts[starts < len(at)]] = False
        shapes[same] = 0
        return words, shapes, lengths

    def of(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word units, shape units, number of words of each list of words)."""
        words, shapes, lengths = self.numbers(split)
        units = np.array(self.units, np.uint64)
        return units[words], units[shapes], lengths


def _pieces(texts: Iterable[str]) -> Iterator[tuple[int, list[str], int, int]]:
    """(number of the text, words, how many in front and behind are only neighbours): a long text comes in several pieces."""
    for number, text in enumerate(texts):
        if len(text) <= PIECE:
            yield number, text.split(), 0, 0
            continue
        before, own, at = [], [], 0
        while at < len(text):
            space = _SPACE.search(text, at + PIECE)
            end = space.start() if space else len(text)
            more, at = text[at:end].split(), end
            if len(own) < WINDOW or len(more) < WINDOW and at < len(text):
                own += more
                continue
            after = more[:WINDOW]
            yield number, before + own + after, len(before), len(after)
            before, own = (before + own)[-WINDOW:], more
        yield number, before + own, len(before), 0


def _portions(texts: Iterable[str]) -> Iterator[tuple[list[int], list[list[str]], np.ndarray]]:
    """(numbers of the texts, their words, which of all these words count) of as many pieces as a task works on at a time."""
    held, size = [], 0
    for piece in chain(_pieces(texts), (None,)):
        if piece is not None:
            held.append(piece)
            size += len(piece[1])
        if held and (piece is None or size >= PIECE // 8):
            counts = [np.r_[np.zeros(a, bool), np.ones(len(w) - a - b, bool), np.zeros(b, bool)] for _, w, a, b in held]
            yield [n for n, _, _, _ in held], [w for _, w, _, _ in held], np.concatenate(counts)
            held, size = [], 0


def index_vectors(units: np.ndarray) -> np.ndarray:
    """The fixed sparse vectors of ones and minus ones, a function of the unit: each of the parts has one at a place of its own."""
    part = DIMENSIONS // NONZERO
    vectors = np.zeros((len(units), DIMENSIONS), np.float32)
    for k in range(NONZERO):
        bits = (units >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
        vectors[np.arange(len(units)), part * k + (bits >> 1) % part] = 2 * (bits & 1) - 1
    return vectors


class Grown:
    """An array with a row for each number of a unit, which ``make`` gives for units that are new."""

    def __init__(self, make: Callable[[np.ndarray], np.ndarray]):
        self.make, self.size = make, 0
        self.table = make(np.empty(0, np.uint64))

    def of(self, units: Units) -> np.ndarray:
        new = np.array(units.units[self.size:], np.uint64)
        if len(new):
            if len(units.units) > len(self.table):
                more = np.zeros((max(5 * len(self.table) // 4, len(units.units)), *self.table.shape[1:]), self.table.dtype)
                more[:self.size] = self.table[:self.size]
                self.table = more
            self.table[self.size:len(units.units)] = self.make(new)
            self.size = len(units.units)
        return self.table


def _small_vectors(units: np.ndarray) -> np.ndarray:
    return index_vectors(units).astype(np.int8)


def _contexts(words: np.ndarray, shapes: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of its neighbours and of their shapes; none is over 4 * WINDOW, so a byte holds it."""
    between = np.insert(np.zeros(len(words), bool), np.repeat(np.cumsum(lengths)[:-1], WINDOW), True)
    own = np.zeros((len(between), DIMENSIONS), np.int8)
    own[~between] = vectors.take(words, axis=0) + vectors.take(shapes, axis=0)
    around = np.zeros_like(own)
    for step in range(1, WINDOW + 1):
        around[step:] += own[:-step]
        around[:-step] += own[step:]
    return around[~between]


def _added(keys: np.ndarray, rows: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows) of sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], np.add.reduceat(rows, starts, axis=0, dtype=dtype) if len(keys) else rows.astype(dtype)


class Sums:
    """Sums by unit, passed on before they get too many or too large."""

    NAMES = ["unit", "n", *(f"s{k}" for k in range(DIMENSIONS))]

    def __init__(self):
        self.units, self.vectors = Units(), Grown(_small_vectors)
        self.sums = Grown(lambda new: np.zeros((len(new), DIMENSIONS + 1), np.int32))
        self.tokens = 0

    def add(self, split: list[list[str]], counts: np.ndarray) -> None:
        """Of the words that count, and of their shapes: how often, and the sum of their contexts."""
        words, shapes, lengths = self.units.numbers(split)
        around = _contexts(words, shapes, lengths, self.vectors.of(self.units))
        table = self.sums.of(self.units)
        for own in (words, shapes):
            at = np.flatnonzero(counts)
            at = at[np.argsort(own[at], kind="stable")]
            there, sums = _added(own[at], around.take(at, axis=0), np.int32)
            table[there, 1:] += sums
            table[there, 0] += np.diff(np.r_[np.searchsorted(own[at], there), len(at)]).astype(np.int32)
        self.tokens += 2 * int(counts.sum())

    def full(self) -> bool:
        return len(self.units.units) >= HELD or self.tokens >= TOKENS

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        units, table = np.array(self.units.units, np.uint64).view(np.int64), self.sums.of(self.units)
        there = np.flatnonzero(table[:len(units), 0])
        for at in range(0, len(there), 20_000):
            some = there[at:at + 20_000]
            yield from _narrow(units[some], table[some, 0], table[some, 1:])
        self.__init__()


HEAD = 10  # bytes in front of the sums, of a unit that a document asks for


def _head(units: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``_vectors`` needs besides the sums: the bits of the unit that ``index_vectors`` reads, and how often it is there."""
    bits = sum((units >> np.uint64(16 * k) & np.uint64(15)) << np.uint64(4 * k) for k in range(NONZERO))
    return np.c_[bits.astype("<u2")[:, None].view(np.uint8), n.astype("<i8")[:, None].view(np.uint8)]


def _asked(packed: pa.Array) -> np.ndarray:
    """The vectors of units that were asked for."""
    at = _starts(packed)[:-1, None] + np.arange(HEAD)
    head = np.frombuffer(packed.buffers()[2], np.uint8)[at] if len(packed) else np.empty((0, HEAD), np.uint8)
    bits = np.ascontiguousarray(head[:, :2]).view("<u2")[:, 0].astype(np.uint64)
    units = sum((bits >> np.uint64(4 * k) & np.uint64(15)) << np.uint64(16 * k) for k in range(NONZERO))
    return _vectors(units, np.ascontiguousarray(head[:, 2:]).view("<i8")[:, 0].astype(np.float32), _wide(packed, HEAD).astype(np.float32))


def _starts(packed: pa.Array) -> np.ndarray:
    """Where each value begins, and the end of the last."""
    if not len(packed):
        return np.zeros(1, np.int32)
    return np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]


def _narrow(units: np.ndarray, n: np.ndarray, sums: np.ndarray, head: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(unit, n, sums), where the sums of a row have half a byte each, or one, two, four or eight, as the largest needs; behind ``head``."""
    largest, least = np.abs(sums).max(axis=1, initial=0), -1
    for bits, most in ((4, 7), (8, 127), (16, 32767), (32, (1 << 31) - 1), (64, (1 << 63) - 1)):
        here = np.flatnonzero((largest > least) & (largest <= most))
        least = most
        if len(here):
            own = sums[here]
            data = ((own[:, ::2] + 8) << 4 | own[:, 1::2] + 8).astype(np.uint8) if bits == 4 else own.astype(f"<i{bits // 8}")
            data = np.ascontiguousarray(data).view(np.uint8).reshape(len(here), -1)
            data = data if head is None else np.c_[head[here], data]
            ends = np.arange(len(here) + 1, dtype=np.int32) * data.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(units[here]), pa.array(n[here], pa.int64()), packed], ["unit", "n", "sums"])


def _wide(packed: pa.Array, head: int = 0) -> np.ndarray:
    """The sums of ``_narrow``."""
    sums = np.empty((len(packed), DIMENSIONS), np.int64)
    if not len(packed):
        return sums
    ends, data = _starts(packed), np.frombuffer(packed.buffers()[2], np.uint8)
    for width in np.unique(np.diff(ends)).tolist():
        here = np.flatnonzero(np.diff(ends) == width)
        own = data[ends[here][:, None] + np.arange(head, width)]
        if 2 * (width - head) == DIMENSIONS:
            sums[here, ::2], sums[here, 1::2] = (own >> 4).astype(int) - 8, (own & 15).astype(int) - 8
        else:
            sums[here] = own.view(f"<i{(width - head) // DIMENSIONS}")
    return sums


def unit_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(unit, n, s0, ...) of every word and shape of all documents: how often it is there, and the sum of its contexts.

    The table grows with the vocabulary. Each task adds up what it has room for; the sums of a unit come together in
    order, so that adding up needs no room. All sums are of whole numbers, so their order doesn't matter.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for _, split, counts in _portions(x.as_py() or "" for x in batch.column(0)):
                if counts.any():
                    sums.add(split, counts)
                if sums.full():
                    yield from sums.passed_on()
        yield from sums.passed_on()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sums = np.empty(0, np.int64), np.empty((0, DIMENSIONS + 1), np.int64)
        for batch in chain(batches, (None,)):
            last = batch is None
            if not last:
                units = np.r_[units, batch.column(0).to_numpy()]
                sums = np.r_[sums, np.c_[batch.column(1).to_numpy(), _wide(batch.column(2))]]
            units, sums = _added(units, sums, np.int64)
            done = len(units) - (not last)  # rows of the last unit may follow
            if done > 0:
                yield pa.RecordBatch.from_arrays([pa.array(units[:done]), *(pa.array(np.ascontiguousarray(c)) for c in sums[:done].T)], Sums.NAMES)
                units, sums = units[done:], sums[done:]

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(local, "unit long, n long, sums binary")
    parts = parts.repartition("unit").sortWithinPartitions("unit")
    sums = written(parts.mapInArrow(together, ", ".join(f"{name} long" for name in Sums.NAMES)), "units")
    release(docs.sparkSession)
    return sums


def _vectors(units: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A unit's own index vector and the mean of its contexts."""
    return _unit_length(sums / n[:, None]) + index_vectors(units) / np.float32(np.sqrt(NONZERO))


def _read(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Units and their vectors, in single precision from the start: the driver and each worker hold many."""
    units, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.float32)
    sums = np.empty((len(units), DIMENSIONS), np.float32)
    for k in range(DIMENSIONS):
        sums[:, k] = batch.column(k + 2).to_numpy()
    return units, _vectors(units, n, sums)


def frequent(sums: DataFrame) -> int:
    """The least power of two that at most FREQUENT units occur as often as."""
    total, least = 0, 1 << 62
    for k, n in sorted(sums.groupBy(F.floor(F.log2("n")).alias("k")).count().collect(), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = 1 << k
    return least


def _unit_length(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), x.dtype.type(1e-9))


def pooled(docs: DataFrame, sums: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None,
           spent: bool = False) -> DataFrame:
    """(doc_id, features, number): per row of ``docs`` the mean vector of its words, that of its shapes, and the log of its length.

    ``number`` is the column ``row``, if that is given. Vectors of frequent units, a fixed number, are looked up by each task. A
    unit that is there only once has its whole context where it is met. The sums of the others come by a join. With ``spent``
    the table ``sums`` goes as soon as it has been read.
    """
    spark = docs.sparkSession
    least = frequent(sums)
    units, vectors = _read(sums.where(F.col("n") >= least).toArrow())
    order = np.argsort(units)
    bits = Bits(sums.where((F.col("n") > 1) & (F.col("n") < least)).select(F.col("unit").alias("key")), FILTER)
    # at most 18 MB; the last row is that of units which aren't among them, so that no task copies the table to add it
    shared = spark.sparkContext.broadcast((units[order], np.r_[vectors[order], np.zeros((1, DIMENSIONS), np.float32)], bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, bits = shared.value

        def places(units: np.ndarray) -> np.ndarray:
            """Where the table has the unit's vector; -1: the join has its sums; -2: it is there only once."""
            found = np.searchsorted(keys, units)
            known = found < len(keys)
            known[known] = keys[found[known]] == units[known]
            return np.where(known, found, np.where(bits.may_have(units), -1, -2)).astype(np.int32)

        units, place, small = Units(), Grown(places), Grown(_small_vectors)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sums, total = np.zeros((part.num_rows, 2 * DIMENSIONS)), np.zeros(part.num_rows, np.int64)
                others: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
                for numbers, split, counts in _portions(x.as_py() or "" for x in part.column(1)):
                    if len(units.units) >= HELD:
                        units, place, small = Units(), Grown(places), Grown(_small_vectors)
                    *both, lengths = units.numbers(split)
                    ends = np.cumsum(lengths).tolist()
                    text = np.repeat(numbers, lengths)
                    total += np.bincount(text[counts], minlength=part.num_rows)
                    found, around = place.of(units), _contexts(*both, lengths, small.of(units))
                    seen = np.array(units.units, np.uint64)
                    for k, own in enumerate(both):
                        here = found[own]
                        values = table.take(here, axis=0, mode="wrap")
                        if not counts.all():
                            values[~counts] = 0
                        once = np.flatnonzero((here == -2) & counts)
                        values[once] = _vectors(seen[own[once]], np.ones(len(once), np.float32), around[once].astype(np.float32))
                        for number, first, end in zip(numbers, [0, *ends], ends):
                            sums[number, k * DIMENSIONS:(k + 1) * DIMENSIONS] += values[first:end].sum(axis=0, dtype=np.float64)
                        asked = np.flatnonzero((here == -1) & counts)
                        others[k].append((text[asked], seen[own[asked]]))
                columns = []
                for found in others:
                    text, rare = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
                    offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=part.num_rows))].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare.view(np.int64))))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), flat, *columns, part.column(2)],
                                                 ["doc_id", "n", "sums", "words", "shapes", "number"])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All units that a task may ask for."""
        for batch in batches:
            may = np.flatnonzero(shared.value[2].may_have(batch.column(0).to_numpy().view(np.uint64)))
            units, n, *own = (column.to_numpy()[may] for column in batch.columns)
            for found in _narrow(units, n, np.stack(own, 1), _head(units.view(np.uint64), n)):
                yield found.select(["unit", "sums"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of documents with the units that they asked for."""
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids, n, sums, *asked, number = batch.columns
            sums, n = sums.flatten().to_numpy().reshape(-1, 2 * DIMENSIONS).copy(), n.to_numpy()
            for k, lists in enumerate(asked):
                text = np.repeat(np.arange(len(n)), lists.value_lengths().fill_null(0).to_numpy())
                there, more = _added(text, _asked(lists.flatten()), np.float64)
                sums[there, k * DIMENSIONS:(k + 1) * DIMENSIONS] += more
            features = np.c_[sums / np.maximum(n, 1)[:, None], np.log1p(n) / 10].astype(np.float32)
            offsets = np.arange(len(n) + 1, dtype=np.int32) * features.shape[1]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(features.ravel())), number],
                                             ["doc_id", "features", "number"])

    number = F.lit(None) if row is None else F.col(row)
    narrow = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"), number.cast("long"))
    release(spark)
    rows = narrow.mapInArrow(run, "doc_id long, n long, sums array<double>, words array<long>, shapes array<long>, number long")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sums")
    rare = sums.where(F.col("n") < least).mapInArrow(looked_up, "unit long, sums binary")
    asked = rows.select("row", F.lit(0).alias("kind"), F.explode("words").alias("unit")).unionByName(
        rows.select("row", F.lit(1).alias("kind"), F.explode("shapes").alias("unit")))
    given = written(asked.join(rare, "unit").select("row", "kind", F.col("sums").alias("given")), "given")
    shared.destroy()
    discard(*[sums] * spent)
    release(spark)
    # lists of a few units are larger than the units, so these are dealt out first
    lists = given.repartition("row").groupBy("row").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("given"))).alias(f"given{k}") for k in (0, 1)])
    together = rows.drop("words", "shapes").join(lists, "row", "left").select("doc_id", "n", "sums", "given0", "given1", "number")
    found = written(together.mapInArrow(means, "doc_id long, features array<float>, number long"), "pooled")
    discard(rows, given)
    return found


@dataclass
class Network:
    """One hidden layer; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 3e-3,
          decay: float = 1e-4, seed: int = 7) -> Network:
    """Cross-entropy by Adam; with no rows, or one class only, the network returns the (smoothed) share of ones."""
    random, width = np.random.default_rng(seed), x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(width)
    net = Network(x.mean(axis=0) if len(x) else np.zeros(width), scale, random.normal(0, width ** -0.5, (width, hidden)),
                  np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    x = (x - net.mean) / net.scale
    state = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, step = order[at:at + batch], step + 1
            w1, b1, w2, b2 = state
            h = np.tanh(x[rows] @ w1 + b1)
            error = (_sigmoid(h @ w2 + b2) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (1 - h * h)
            slopes = [x[rows].T @ back + decay * w1, back.sum(axis=0), h.T @ error + decay * w2, np.array([error.sum()])]
            for p, g, (m, v) in zip(state, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *state[:3], float(state[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """The temperature with the least cross-entropy on rows that the network hasn't seen."""
    if len(np.unique(y)) < 2:
        return
    logit, sign = net.logit(x), 2 * y - 1
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
    net.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -sign * logit / t).mean()))


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7, doc_id: str = "doc_id",
          text: str = "text", label: str = "quality", row: str | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Word and shape vectors come from all texts. The network learns from at most ``sample`` labelled documents (those with
    the smallest hashes of their ids) whose fold isn't 2: folds 0 and 1 train, fold 3 sets the temperature. A score
    depends on the text and on the vectors that all texts gave; empty and null texts get one as well. A text of any length is worked on in pieces. Labels that are null, other than 0 and 1, or
    contradict each other for one id are not learned from; of rows that repeat an id one is. A row with a null id is
    scored, and not held out. ``row`` names a column that is carried to the result.
    """
    sums = unit_sums(docs, text)
    features = pooled(docs, sums, doc_id, text, row, spent=True)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.min(label).alias("y"), F.max(label).alias("high")).where("y = high and doc_id is not null")
    learn = features.withColumn("fold", fold()).where("fold != 2").join(known, "doc_id").select(
        "doc_id", "fold", "y", "features").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample)
    rows = learn.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.stack(rows["features"]).astype(float) if len(rows) else np.empty((0, 2 * DIMENSIONS + 1))
    y, late = rows["y"].to_numpy(float), (rows["fold"] == 3).to_numpy(bool)
    net = train(x[~late], y[~late])
    calibrate(net, x[late], y[late])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.probability(x)), batch.column(2)],
                                             ["doc_id", "score", "number"])

    scored = features.mapInArrow(run, "doc_id long, score double, number long")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"),
                         *([F.col("number").alias(row)] if row else []))
