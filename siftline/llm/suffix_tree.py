"""Language-model scores by a probabilistic suffix tree over the words of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, release, written

END = 0  # the symbol after a text and before each
STREAM = 1 << 22  # bytes of text worked on at a time
TEXTS = 1 << 16  # texts worked on at a time
WORDS = 400_000  # distinct words a task counts before it passes the counts on
HEAVY = 1 << 17  # most frequent words whose counts every executor has
ENTRIES = 1 << 20  # places in the texts whose entries of the model a task works out at a time
PARTS = 3  # parts of the contexts, by their newest symbol, that are worked on one after the other
DEAL = 1  # tells the hashes that deal out symbols from those of contexts
FILTER = 28  # bits of a key by which an executor tells that it isn't among those asked for


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, each word's place among the distinct ones, the distinct words).

    Words are in small A-Z. Of bytes, white space is 0x20 and 0x09-0x0D.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    offsets, words = lists.offsets.to_numpy(), lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    before = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    words = words.filter(some).dictionary_encode()
    return np.diff(before[offsets - offsets[0]]), words.indices.to_numpy(), words.dictionary.view(pa.binary())


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Rows in bounded portions, with the words of their last column, a text, as ``_split`` has them; a long text is one of its own."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        filled = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            most = int(np.searchsorted(filled, (filled[start - 1] if start else 0) + STREAM, side="right"))
            end = min(max(start + 1, most), start + TEXTS)
            yield batch.slice(start, end - start), *_split(texts.slice(start, end - start))
            start = end


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) with repeated words, not yet added up; a null word stands for the end, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, _, numbers, words in _portions(batches):
            held += [_counted(words, np.bincount(numbers, minlength=len(words))), _counted(pa.nulls(1, pa.binary()), np.array([rows.num_rows]))]
            size += len(words) + 1
            if size >= 2 * WORDS:
                held = [_added(held)]
                size = held[0].num_rows
                if size >= WORDS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _added(held).to_batches()

    return texts.mapInArrow(run, "word binary, n long")


def _counted(words: pa.Array, counts: np.ndarray) -> pa.Table:
    return pa.table({"word": words, "n": pa.array(counts, pa.int64())})


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])


def _mix(strings: np.ndarray, symbols: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of strings with one more symbol."""
    x = (strings ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + symbols
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _dealt(symbols: np.ndarray) -> np.ndarray:
    return _mix(np.zeros(len(symbols), np.uint64), symbols, DEAL)


def identity() -> Column:
    """The symbol of a word, as ``_identities`` has it; that of null, the end, is END."""
    return F.when(F.col("word").isNull(), F.lit(END).cast("long")).otherwise(F.xxhash64("word"))


def _identities(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(word, 42) for word in words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))


def _hash_longs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                                                 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    seed = np.full(len(first), 42, np.uint64)
    for value in (first, second):
        x = (seed + p5 + np.uint64(8)) ^ (turned(value * p2, 31) * p1)
        x = turned(x, 27) * p1 + p4
        for shift, factor in ((33, p2), (29, p3)):
            x = (x ^ (x >> np.uint64(shift))) * factor
        seed = x ^ (x >> np.uint64(32))
    return seed


def _stream(lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The symbols of texts, one END after each text."""
    out = np.full(len(symbols) + len(lengths), END, symbols.dtype)
    words = np.ones(len(out), bool)
    words[np.cumsum(lengths + 1) - 1] = False
    out[words] = symbols
    return out


def _places(stream: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, the strings that they are, pairs of the token and the context one symbol shorter) at the places of a stream that have
    a context of ``depth`` symbols.

    A context is hashed from its newest symbol to its oldest; none reaches over an END, which may be the oldest. As a string
    it is the pair of its newest symbol and the others, a single symbol is itself: where that pair, or symbol, is seen, the context follows.
    """
    symbols = np.r_[np.uint64(END), stream]
    ends = np.zeros(len(symbols), bool)
    ends[0] = True
    ends[np.cumsum(lengths + 1)] = True
    places = np.arange(len(symbols) - 1)
    contexts, strings, shorter = _mix(np.zeros(len(places), np.uint64), symbols[:-1], 0), symbols[:-1], symbols[1:]
    for length in range(2, depth + 1):
        pairs, before = _hash_longs(contexts, shorter), places
        longer = (places >= length - 1) & ~ends[places - length + 2]
        places, contexts = places[longer], contexts[longer]
        strings, shorter = pairs[np.searchsorted(before, places - 1)], pairs[longer]
        contexts = _mix(contexts, symbols[places - length + 1], 0)
    return contexts, strings, shorter


class Bits:
    """Bits of the hashes of keys, which rule out most others: a key that isn't among them is seldom told to be."""

    def __init__(self, keys: DataFrame, size: int = FILTER):
        self.size, self.bits = size, np.zeros(1 << size - 3, np.uint8)
        # Spark ORs the bits into blocks of 4 KB, so that at most 2 ** (size - 15) rows come to the driver
        place = F.shiftrightunsigned("key", 64 - size) + 1
        blocks = keys.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        for block, bits in blocks.collect():
            self.bits[(block - 1) * len(bits):block * len(bits)] = np.frombuffer(bits, np.uint8)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - self.size)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pairs(texts: DataFrame, level: int, shared: Broadcast) -> DataFrame:
    """(context, shorter, n): how often each token follows each context of ``level`` symbols whose string the shared ``Bits`` may have.

    ``shorter`` is the pair of the token and the context without its oldest symbol; the token itself, if that is empty. Spark adds up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = shared.value
        for _, lengths, numbers, words in _portions(batches):
            contexts, own, shorter = _places(_stream(lengths, _identities(words)[numbers]), lengths, level)
            wanted = np.flatnonzero(strings.may_have(own))
            contexts, shorter = contexts[wanted], shorter[wanted]
            _, first, times = np.unique(_hash_longs(contexts, shorter), return_index=True, return_counts=True)
            columns = [contexts[first].view(np.int64), shorter[first].view(np.int64), times]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["context", "shorter", "n"])

    return texts.mapInArrow(run, "context long, shorter long, n long").groupBy("context", "shorter").agg(F.sum("n").alias("n"))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, the bytes of equal weight side by side."""
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    raw = b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(value: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    lengths, at, arrays = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(lengths.tolist(), map(np.dtype, kinds)):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return arrays


class Symbols:
    """Symbols of a portion: END, the ranks of heavy words, and the identities of all others, which are far greater numbers."""

    def __init__(self, heavy: pa.Table, ends: int):
        self.top = heavy.num_rows
        self.words = heavy["word"].cast(pa.binary()).combine_chunks()
        self.counts = np.r_[np.int64(ends), heavy["c"].to_numpy()]
        self.identities = np.r_[np.uint64(END), _identities(self.words)]

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks from 1, or 0."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy() + 1

    def short(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(4 bytes for each symbol, the light ones)."""
        light = symbols > self.top
        return np.where(light, self.top + 1, symbols).astype(np.uint32), symbols[light]

    def long(self, short: np.ndarray, light: np.ndarray) -> np.ndarray:
        symbols = short.astype(np.uint64)
        symbols[short > self.top] = light
        return symbols

    def identity(self, symbols: np.ndarray) -> np.ndarray:
        out, heavy = symbols.copy(), symbols <= self.top
        out[heavy] = self.identities[symbols[heavy]]
        return out


CODED = "block long, doc_id array<long>, held array<boolean>, codes binary, rare array<binary>"
SCORED = ("block long, doc_id array<long>, held array<boolean>, n_tokens array<long>, known array<long>, base array<double>, "
          "codes binary, light binary")


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _one(values: pa.Array | np.ndarray) -> pa.ListArray:
    """One list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def coded(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """A row for each portion of ``texts`` (doc_id, held, text): its tokens as numbers, those above the heavy ranks being places in ``rare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, first = shared.value, TaskContext.get().partitionId() << 24
        for block, (rows, lengths, numbers, words) in enumerate(_portions(batches), first):
            code = symbols.ranks(words).astype(np.uint32)
            light = np.flatnonzero(code == 0)
            code[light] = symbols.top + 1 + np.arange(len(light))
            rare = words.take(pa.array(light))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _one(rows.column(0)), _one(rows.column(1)),
                                              pa.array([_packed(_stream(lengths, code[numbers]))], pa.binary()), _one(rare)], _names(CODED))

    return texts.mapInArrow(run, CODED)


def answered(portions: DataFrame, light: DataFrame) -> DataFrame:
    """(block, answers): counts of the words in ``rare`` of each portion. ``light`` has (word, c) of those that were ever counted."""
    asked = portions.select("block", F.posexplode("rare").alias("place", "word")).join(light.hint("shuffle_hash"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found in zip(*batch.columns):
                place, c = (found.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(place)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([_packed(place[order], c[order])], pa.binary())],
                                                 ["block", "answers"])

    return asked.groupBy("block").agg(F.collect_list(F.struct("place", "c"))).mapInArrow(run, "block long, answers binary")


def counted(portions: DataFrame, answers: DataFrame, shared: Broadcast) -> DataFrame:
    """Portions of ``coded`` with what the root has of each text, and the identities and counts of their light words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, held, packed, rare, found = (batch.column(k).slice(row, 1) for k in range(6))
                words = rare.flatten()
                counts = np.zeros(len(words), np.int64)
                if found[0].is_valid:
                    place, c = _unpacked(found[0].as_py(), np.int32, np.int64)
                    counts[place] = c
                codes, = _unpacked(packed[0].as_py(), np.uint32)
                every, ends = np.r_[symbols.counts, counts], np.flatnonzero(codes == END)
                lengths = np.diff(ends, prepend=-1)
                of = np.repeat(np.arange(len(ends)), lengths)
                base = np.bincount(of, np.log10(every + 1.0)[codes], len(ends))
                known = np.bincount(of, every[codes] > 0, len(ends)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([block, ids, held, _one(lengths), _one(known), _one(base), packed,
                                                  pa.array([_packed(_identities(words), counts)], pa.binary())], _names(SCORED))

    return portions.join(answers, "block", "left").select(*_names(CODED), "answers").mapInArrow(run, SCORED)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the group of each key, a place of each group); keys are hashes."""
    # numbers sort faster than places of numbers: the low bits give way to the place, which is undone where they would have mattered
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    near = order[1:] ^ order[:-1] <= low
    order = (order & low).astype(np.int32)
    ordered = keys[order]
    begins = np.ones(len(keys), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    if (begins[1:] & near).any():
        order = np.argsort(keys).astype(np.int32)
        ordered = keys[order]
        begins[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(begins, dtype=np.int32) - 1
    return of, order[begins]


def _kept(n: np.ndarray, p: np.ndarray, of: np.ndarray, contexts: int, least: int, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(totals of contexts, which are kept, probabilities of pairs after theirs).

    A pair is a token counted ``n`` times after the context ``of``, and has the probability ``p`` after the context one symbol shorter.
    A kept context has its share for tokens not seen after it.
    """
    seen = n > 0
    total, kinds = np.bincount(of, n, contexts), np.bincount(of[seen], minlength=contexts)
    events = np.maximum(total + kinds, 1)
    own, rest = (n + kinds[of] * p) / events[of], np.maximum(kinds, 1e-9) / events
    likelier = np.bincount(of[seen], own[seen] * np.log2(own[seen] / p[seen]), contexts)
    unseen = np.maximum(0.0, 1 - np.bincount(of[seen], p[seen], contexts))
    return total, (total >= max(least, 1)) & (total * (likelier + rest * unseen * np.log2(rest)) >= gain), own


def _grown(contexts: list[np.ndarray], tokens: np.ndarray, p: np.ndarray, train: np.ndarray, least: int, gain: float, begun: bool) -> np.ndarray:
    """The probability of each token after the longest of its contexts that is kept.

    ``contexts``: the symbols before the token, newest first; END comes last and is repeated; they are used up. All places of a context
    must be there, or of one of two symbols if those of one are done (``begun``). A context can't occur more often than the one a symbol shorter.
    """
    p, at, keys = p.copy(), np.arange(len(p), dtype=np.int32), np.zeros(len(p), np.uint64)
    for length in range(len(contexts)):
        symbols = contexts.pop(0)[at]
        keys, longer = _mix(keys, symbols, 0), symbols != END
        if begun and not length:
            at, keys = at[longer], keys[longer]
            continue
        if not len(at):
            break
        of, any_place = _groups(keys)
        pair, first = _groups(_mix(keys, tokens[at], 0))
        total, kept, own = _kept(np.bincount(pair, train[at]), p[at][first], of[first], len(any_place), least, gain)
        chosen = np.flatnonzero(kept[of])
        p[at[chosen]] = own[pair[chosen]]
        longer &= (total >= least)[of]
        at, keys = at[longer], keys[longer]
    return p


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """((bucket, sub), values) of rows that are in that order."""
    key, values = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            bucket, sub, value = (column[row].as_py() for column in batch.columns)
            if (bucket, sub) != key and values:
                yield key, values
                values = []
            key = bucket, sub
            values.append(value)
    if values:
        yield key, values


DEALT = "bucket int, sub int, value binary"


def _rows(found: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    found = iter(found)
    while some := list(islice(found, 100)):
        bucket, sub, value = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(sub, pa.int32()), pa.array(value, pa.binary())], _names(DEALT))


def _in_order(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "sub")


def _runs(keys: np.ndarray) -> zip:
    """(begin, end) of equal keys in a row."""
    cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)].tolist() if len(keys) else [0]
    return zip(cuts[:-1], cuts[1:])


def _deal(hashes: np.ndarray, among: int) -> np.ndarray:
    """A number below ``among``, which grows with the hash."""
    return (hashes >> np.uint64(32)) * np.uint64(among) >> np.uint64(32)


def model(portions: DataFrame, frequent: DataFrame | None, shared: Broadcast, part: int, tokens: int, size: int, least: int, depth: int,
          gain: float, entries: int) -> DataFrame:
    """(row, value): what the contexts of one part of the tree add to the log10 probability of each text of ``counted``.

    All contexts that end with the same symbol are in one part and one bucket, so that a task has all places of each, and the
    counts and probabilities of the contexts one symbol shorter. Buckets hold about half of ``entries`` places. A newest symbol with more than that
    has a bucket of its own: its pairs come first, as ``frequent`` (context, shorter, n, c) has them, then its places, some at a time, by the symbol before, or the token.
    """
    buckets = max(32, 2 * tokens // (PARTS * entries) + 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, kept, size = shared.value, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                block, held, packed, light = (column[row].as_py() for column in batch.columns)
                codes, = _unpacked(packed, np.uint32)
                identities, counts = _unpacked(light, np.uint64, np.int64)
                known = np.r_[np.arange(symbols.top + 1, dtype=np.uint64), identities]
                contexts = [np.r_[np.uint32(END), codes[:-1]]]
                at = np.flatnonzero((_dealt(known) % np.uint64(PARTS) == part)[contexts[0]])
                for _ in range(1, depth):
                    contexts.append(np.where(contexts[-1] == END, np.uint32(END), np.r_[np.uint32(END), contexts[-1][:-1]]))
                of = np.r_[0, np.cumsum(codes == END)[:-1]][at]
                kept.append((known, counts, [*(x[at] for x in contexts), codes[at]], ~np.array(held, bool)[of], block, of.astype(np.uint16)))
                size += len(at)
                if size >= entries // 2:
                    yield from flush(kept, symbols)
                    kept, size = [], 0
        if kept:
            yield from flush(kept, symbols)

    def flush(kept: list[tuple], symbols: Symbols) -> Iterator[pa.RecordBatch]:
        def column(k: int) -> np.ndarray:
            return np.concatenate([known[codes[k]] for known, _, codes, *_ in kept])

        newest = column(0)
        hashes, often = _dealt(newest), newest <= symbols.top
        often[often] = symbols.counts[newest[often]] > entries
        bucket, sub = _deal(hashes, buckets).astype(np.uint32), np.zeros(len(newest), np.uint32)
        rest, often = np.flatnonzero(~often), np.flatnonzero(often)
        own = newest[often]
        bucket[often] = buckets + own
        before = np.where(own == END, column(depth)[often], column(min(1, depth - 1))[often])  # nothing is before END
        sub[often] = 1 + _dealt(before) % (symbols.counts[own] // max(1, entries // 2)).astype(np.uint64)
        order = np.r_[rest[np.argsort(hashes[rest])], often[np.lexsort((sub[often], bucket[often]))]]
        del newest, hashes, rest, often, own, before
        bucket, sub = bucket[order], sub[order]
        cuts = np.r_[0, np.flatnonzero((np.diff(bucket) != 0) | (np.diff(sub) != 0)) + 1, len(order)]
        columns = []
        for k in range(depth + 1):
            short, light = symbols.short(column(k)[order])
            of = np.flatnonzero(short > symbols.top)
            columns += [(short, cuts), (light, np.searchsorted(of, cuts))]
        count = np.concatenate([np.r_[np.zeros(symbols.top + 1, np.int64), counts][codes[-1]] for _, counts, codes, *_ in kept])[order][of]
        train = np.concatenate([train for *_, train, _, _ in kept])[order]
        row = np.concatenate([np.uint64(block << 16) + of for *_, block, of in kept])[order]
        columns += [(count, columns[-1][1]), (train, cuts), (row, cuts)]
        if len(order):
            yield from _rows((int(bucket[begin]), int(sub[begin]), _packed(*(x[at[k]:at[k + 1]] for x, at in columns)))
                             for k, begin in enumerate(cuts[:-1].tolist()))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, kept, size = shared.value, [], 0
        newest = np.flatnonzero(symbols.counts > entries).astype(np.uint64)
        newest = newest[_dealt(newest) % np.uint64(PARTS) == part]
        contexts = _mix(np.zeros(len(newest), np.uint64), symbols.identities[newest], 0)
        newest, contexts = newest[np.argsort(contexts)], np.sort(contexts)

        def passed() -> Iterator[pa.RecordBatch]:
            context, *values = map(np.concatenate, zip(*kept))
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            mine = np.flatnonzero(contexts[at] == context)
            mine = mine[np.argsort(at[mine])]
            at, values = at[mine], [x[mine] for x in values]
            if len(mine):
                yield from _rows((buckets + int(newest[at[begin]]), 0, _packed(*(x[begin:end] for x in values))) for begin, end in _runs(at))

        for batch in batches if len(newest) else ():
            kept.append([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64),
                         batch.column(2).to_numpy(), batch.column(3).to_numpy()])
            size += batch.num_rows
            if size >= entries:
                yield from passed()
                kept, size = [], 0
        if kept:
            yield from passed()

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, pair, found, held = shared.value, None, [], 0
        kinds = [*(np.uint32, np.uint64) * (depth + 1), np.int64, np.bool_, np.uint64]
        for (bucket, sub), values in _gathered(batches):
            if bucket >= buckets and not sub:
                word, n, c = map(np.concatenate, zip(*(_unpacked(value, np.uint64, np.int64, np.int64) for value in values)))
                order = np.argsort(word)
                _, kept, _ = _kept(n.astype(float), (c + 1) / size, np.zeros(len(n), np.int64), 1, least, gain)
                pair = word[order], n[order], bool(kept[0])
                continue
            *short, count, train, row = map(np.concatenate, zip(*(_unpacked(value, *kinds) for value in values)))
            *contexts, token = (symbols.long(a, b) for a, b in zip(short[::2], short[1::2]))
            del short
            values.clear()
            every = np.empty(len(token), np.int64)
            heavy = token <= symbols.top
            every[heavy], every[~heavy] = symbols.counts[token[heavy]], count
            root = p = (every + 1) / size
            del every, heavy, count
            if bucket >= buckets and pair[2]:
                word, n, _ = pair
                own = symbols.identity(token)
                at = np.minimum(np.searchsorted(word, own), len(word) - 1)
                p = (np.where(word[at] == own, n[at], 0) + len(n) * p) / (n.sum() + len(n))
            p = _grown(contexts, token, p, train, least, gain, bucket >= buckets)
            at = np.flatnonzero(p != root)
            found.append(_summed(row[at], np.log10(p[at] / root[at])))
            held += len(found[-1][0])
            if held >= entries:
                yield from _by_text(found, buckets)
                found, held = [], 0
        if found:
            yield from _by_text(found, buckets)

    dealt = portions.select("block", "held", "codes", "light").mapInArrow(places, DEALT)
    if frequent is not None:
        dealt = dealt.unionByName(frequent.select("context", "shorter", "n", "c").mapInArrow(summaries, DEALT))
    return _in_order(_in_order(dealt).mapInArrow(gains, DEALT)).mapInArrow(_texts, "row long, value double")


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of, first = _groups(_dealt(rows))
    return rows[first], np.bincount(of, values, len(first))


def _by_text(found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Values of rows, dealt out by their portions."""
    rows, values = _summed(*map(np.concatenate, zip(*found)))
    bucket = _deal(_dealt(rows >> np.uint64(16)), buckets)
    order = np.argsort(bucket)
    bucket, rows, values = bucket[order], rows[order], values[order]
    if len(rows):
        yield from _rows((int(bucket[begin]), 0, _packed(rows[begin:end], values[begin:end])) for begin, end in _runs(bucket))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, value) of values dealt out by ``_by_text``."""
    for _, values in _gathered(batches):
        rows, total = _summed(*map(np.concatenate, zip(*(_unpacked(value, np.uint64, np.float64) for value in values))))
        yield pa.RecordBatch.from_arrays([pa.array(rows.view(np.int64)), pa.array(total)], ["row", "value"])


def score(docs: DataFrame, least: int = 2, depth: int = 3, gain: float = 16.0, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are the words of the text in small A-Z and one end. ``base_score`` adds up log10 of add-one probabilities of
    tokens. ``score`` is the log10 probability of the same tokens by a suffix tree whose root is that base: a token has its
    probability after the longest context kept. Contexts are the strings of up to ``depth`` symbols before the token, of words as they
    are. One is kept if it occurs ``least`` times and what follows it diverges from what follows the context one symbol
    shorter: count x Kullback-Leibler divergence of at least ``gain`` bits. Its distribution is smoothed by that one (Witten-Bell).

    Both learn from all rows whose held_out is false; all counts are over all of them. Words, contexts and pairs are counted
    without bound; strings of words are told apart by 64-bit hashes. The counts of the most frequent words, a fixed number, are
    looked up by each task, those of the others by a join. The tree is worked out a part at a time, next to the places it is asked for.

    A null text counts as empty: its one token is the end. A row with a null id is not held out. With no training text
    all scores are 0. Rows that repeat an id are texts of their own.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    train = narrow.where(~held_out()).select("text")
    counts = written(word_counts(train).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    v, n, ends = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)),
                            F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0))).first()
    heavy = counts.where("word is not null").orderBy(F.desc("c"), "word").limit(HEAVY).toArrow()
    most, last = (heavy["c"][0].as_py(), heavy["c"][-1].as_py()) if len(heavy) else (0, 0)
    shared = spark.sparkContext.broadcast(Symbols(heavy, ends))

    portions = written(coded(narrow.select("doc_id", held_out().alias("held"), "text"), shared), "coded")
    # words as frequent as the last heavy one are never asked for
    light = counts.where(F.col("word").isNotNull() & (F.col("c") <= last))
    answers = written(answered(portions, light), "answers")
    release(spark)
    scored = written(counted(portions, answers, shared), "scored")
    discard(portions, answers)

    frequent = None
    often = counts.where(F.col("c") > ENTRIES).select(identity().alias("key"))
    if max(ends, most) > ENTRIES:
        words = counts.select(identity().alias("shorter"), "c")
        strings = spark.sparkContext.broadcast(Bits(often, 20))
        frequent = written(pairs(train, 1, strings).join(words, "shorter"), "pairs")
        strings.destroy()
    found = []
    for part in range(PARTS):
        found.append(written(model(scored, frequent, shared, part, n, n + v + 1, least, depth, gain, ENTRIES), "model"))
        release(spark)
    if frequent is not None:
        discard(frequent)

    values = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.sum("value").alias("gain"))
    each = scored.select("block", F.posexplode(F.arrays_zip("doc_id", "n_tokens", "known", "base")).alias("place", "text")).select(
        (F.col("block") * TEXTS + F.col("place")).alias("row"), "text.*")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))
    return each.join(values, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.coalesce("gain", F.lit(0.0))).alias("score"))
