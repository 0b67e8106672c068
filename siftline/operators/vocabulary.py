"""Vocabulary tables as matchers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import WORD
from ..functions.text import normalize_text
from ..session import persisted


def terms_to_matcher(vocab: DataFrame, chunk_terms: int = 1000) -> DataFrame:
    """(list, chunk, terms, pattern) of a vocab(list, term) table.

    Terms are normalised, made distinct and joined longest first, as whole words. A list of more than ``chunk_terms``
    has several patterns, dealt by a hash of the term, so every term is in one and no list is gathered in one row.
    """
    plain = vocab.select("list", normalize_text(F.col("term")).alias("term")).where("term <> ''").distinct()
    sizes = plain.groupBy("list").agg(F.count("*").alias("terms"))
    chunks = F.ceil(F.col("terms") / chunk_terms)
    number = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 6), 16, 10).cast("long")
    dealt = plain.join(sizes, "list").select("list", "term", (number % chunks).alias("chunk"))
    quoted = F.regexp_replace("term", r"([\\.^$|?*+()\[\]{}\-&#])", r"\\$1")
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("size"), F.col("term"), quoted.alias("q"))))
    return dealt.groupBy("list", "chunk").agg(F.count("*").alias("terms"), F.concat(
        F.lit(f"(?<![{WORD}])(?:"), F.array_join(F.transform(ordered, lambda t: t["q"]), "|"),
        F.lit(f")(?![{WORD}])")).alias("pattern"))


#: Bits of the filter over a vocabulary: sixteen a term, and no more than this many (half a MB).
MOST_BITS = 1 << 22


def _runs(words: Column, size: int) -> Column:
    """All runs of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))


def term_filter(terms: DataFrame, count: int) -> Callable[[Column], Column] | None:
    """A test that holds for every one of ``terms`` and fails for most other texts; None, where there are too many terms for it to rule anything out.

    Each term sets the bit of its hash; the bits come to the driver as at most ``MOST_BITS`` / 64 numbers and stand in the plan.
    """
    bits = 1 << max(count * 16 - 1, 63).bit_length()
    if bits > MOST_BITS:
        if count > MOST_BITS:
            return None
        bits = MOST_BITS

    def place(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(bits))

    own = terms.select(place(F.col("term")).alias("at"))
    words = own.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    held = [0] * (bits // 64)
    for word, value in words.collect():
        held[word] = value
    # one call builds the array; the least number can't be written without its sign apart
    table = F.expr("array(" + ", ".join(f"{x}L" if x != -(1 << 63) else "shiftleft(1L, 63)" for x in held) + ")")
    return lambda term: F.expr("1") == F.getbit(F.get(table, F.shiftright(place(term), 6).cast("int")), place(term).bitwiseAND(F.lit(63)).cast("int"))


def match_terms(rows: DataFrame, text: str, vocab: DataFrame, key: str = "ord") -> DataFrame:
    """(key, list, term) for every term of a long vocabulary that occurs in a text as whole words.

    The word runs of a row, of the lengths that terms have, are tested against a filter over the vocabulary where they are; the few
    that pass are joined to the distinct terms by equality. So what is shuffled is near the number of hits, not of words.
    """
    terms = persisted(vocab.select("list", normalize_text(F.col("term")).alias("term")).where("term <> ''").distinct(), "terms")
    sizes = terms.groupBy(F.size(F.split("term", " ")).alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()
    words = rows.select(key, F.split(normalize_text(F.col(text)), " ").alias("_words"))
    if not sizes:
        return words.select(key).limit(0).join(terms, F.lit(False)).select(key, "list", "term")
    may_be = term_filter(terms.select("term"), sum(n for _, n in sizes))
    runs = F.array_distinct(F.concat(*[_runs(F.col("_words"), size) for size, _ in sizes]))
    runs = runs if may_be is None else F.filter(runs, may_be)
    return words.select(key, F.explode(runs).alias("term")).join(terms, "term").select(key, "list", "term")
