"""Regex building blocks for Java patterns.

Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII by default, so word limits are spelled with Unicode
classes and case is folded by lower-casing the text first or with ``(?iu)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\p{Z}]"

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-&#])")


def quote(term: str) -> str:
    """Escape a literal so that Java and RE2 read it the same way."""
    return _SPECIAL.sub(r"\\\1", term)


def bounded(body: str) -> str:
    """``body`` as whole words."""
    return rf"(?<![{WORD}])(?:{body})(?![{WORD}])"


def whole(term: str, letters: str = WORD, prefix: str = "") -> str:
    """A literal as a whole word, for long texts.

    The literal comes first and its left limit is looked up behind it, so the engine only leaves its
    fast search where the literal really is. ``prefix`` may stand between the limit and the literal.
    """
    literal = quote(term)
    return rf"{literal}(?<=(?<![{letters}]){prefix}{literal})(?![{letters}])"


def alternation(terms: Iterable[str]) -> str:
    """One alternation over literal terms: distinct, longest first (leftmost-first engines need that)."""
    distinct = {t for t in terms if t}
    return "|".join(quote(t) for t in sorted(distinct, key=lambda t: (-len(t), t)))


def word_matcher(terms: Iterable[str]) -> str:
    return bounded(alternation(terms))


def extract(column: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def literal_array(values: Iterable[str]) -> Column:
    """An array of text literals, built in one call."""
    quoted = (v.replace("\\", "\\\\").replace("'", "\\'") for v in values)
    return F.expr("array(" + ", ".join(f"'{v}'" for v in quoted) + ")")


def let(column: Column, body) -> Column:
    """Evaluate ``column`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(column), body), 1)


_PLAIN = {"UnresolvedAttribute": re.compile(r"[A-Za-z_]\w*"), "Literal": re.compile(r".{0,80}"), "Cast": re.compile(r"CAST\('[\d-]+' AS DATE\)")}


def _name(argument) -> tuple | None:
    """What tells a plain column (one by its name, a short literal, a literal date) or another argument apart; None for any other column."""
    if isinstance(argument, Column):
        kind = argument._jc.node().getClass().getSimpleName()
        shown = str(argument)[8:-2]
        return ("column", kind, shown) if kind in _PLAIN and _PLAIN[kind].fullmatch(shown) else None
    if isinstance(argument, (list, tuple)) and any(isinstance(x, Column) for x in argument):
        names = tuple(map(_name, argument))
        return None if None in names else names
    return (type(argument), argument)


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` gives for the same plain columns and values.

    A large expression takes thousands of calls into the JVM to build, seconds for a cascade; the expression doesn't change and can stand
    in any plan. Other columns, such as the variable of a lambda, are never kept.
    """
    known: dict[tuple, object] = {}

    @wraps(build)
    def run(*arguments, **named):
        names = tuple(map(_name, arguments))
        if named or None in names:
            return build(*arguments, **named)
        key = (id(SparkContext._gateway), *names)
        if key not in known:
            known[key] = build(*arguments)
        return known[key]

    return run
