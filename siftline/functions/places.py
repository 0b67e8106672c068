"""Place expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels as L
from ..vocab import RuleSet
from .patterns import SPACE, WORD, alternation, bounded, built_once, extract, let, literal_array, text_or_empty, word_matcher
from .text import normalize_text, strip

HOME, EXCLUDED, FOREIGN, UNKNOWN = "israel", "excluded", "foreign", "unknown"

_SEPARATORS = rf"{SPACE}*(?:\||;|/| or | או |\n){SPACE}*"
_COUNTRY_CODE = rf",{SPACE}*([A-Za-z]{{2}}){SPACE}*$"


def fold_place_spelling(column: Column, rules: RuleSet) -> Column:
    """One spelling for place words that are written in two ways."""
    text = text_or_empty(column)
    for short, full in rules.place_spelling:
        text = F.regexp_replace(text, f"(?<![א-ת]){short}(?![א-ת])", full)
    return text


def split_locations(location: Column) -> Column:
    """The places named in one location text."""
    parts = F.transform(F.split(text_or_empty(location), _SEPARATORS), strip)
    return F.filter(parts, lambda p: p != "")


def _plain(term: str, rules: RuleSet) -> str:
    import re

    for short, full in rules.place_spelling:
        term = re.sub(f"(?<![א-ת]){short}(?![א-ת])", full, term)
    term = re.sub(r"[/\\\-–—&_,|()\[\]:;+.!?]", " ", re.sub("[\"'`׳״]", "", term.lower()))
    return " ".join(re.sub(r"\band\b", " ", term).split())


@lru_cache(maxsize=64)
def place_matcher(terms: tuple[str, ...], rules: RuleSet) -> str:
    """Whole-word pattern over normalised place terms."""
    return word_matcher(tuple(_plain(t, rules) for t in terms))


@lru_cache(maxsize=16)
def place_alternation(terms: tuple[str, ...], rules: RuleSet) -> str:
    return alternation(tuple(_plain(t, rules) for t in terms))


def _choose(pairs, column: Column) -> Column:
    """The label of the first test that holds."""
    expr = None
    for value, test in pairs:
        expr = F.when(test(column), value) if expr is None else expr.when(test(column), value)
    return expr


def place_parts(location: Column, rules: RuleSet) -> Column:
    """Every part of a location with its kind (home / excluded / foreign / null) and region label."""
    home = place_matcher(rules.home_terms, rules)
    foreign = place_matcher(rules.foreign_terms, rules)
    generic = f"^(?:{alternation(rules.generic_places)})$"
    nationwide = alternation(rules.nationwide_terms)
    states = rf",{SPACE}*(?:{'|'.join(rules.foreign_states)})(?![{WORD}])"
    loc = strip(text_or_empty(location))
    parts = F.transform(split_locations(loc), lambda p: F.struct(
        p.alias("raw"),
        normalize_text(fold_place_spelling(p, rules)).alias("norm"),
        F.upper(F.regexp_extract(p, _COUNTRY_CODE, 1)).alias("code")))
    labelled = F.transform(parts, lambda p: F.struct(
        p["raw"].alias("raw"), p["norm"].alias("norm"), p["code"].alias("code"),
        _choose([(label, lambda n, t=term: n == t) for term, label in rules.bare_regions], p["norm"]).alias("bare"),
        _choose([(label, lambda n, ts=terms: n.rlike(place_matcher(ts, rules)))
                 for label, terms in rules.excluded_regions], p["norm"]).alias("region")))

    def kind(p: Column) -> Column:
        return (F.when((p["norm"] == "") | p["norm"].rlike(generic) | p["norm"].isin(*rules.home_names), None)
                .when(p["bare"].isNotNull(), EXCLUDED)
                .when(p["region"].isNotNull() & ~p["norm"].rlike(nationwide), EXCLUDED)
                .when(p["norm"].rlike(home) | p["raw"].rlike(rules.home_script) | (p["code"] == rules.home_code), HOME)
                .when(p["norm"].rlike(foreign) | p["raw"].rlike(states) | (p["code"] != ""), FOREIGN))

    return F.transform(labelled, lambda p: F.struct(
        p["raw"].alias("raw"), kind(p).alias("kind"), F.coalesce(p["bare"], p["region"]).alias("region")))


@built_once
def classify_location(location: Column, description: Column, url: Column, context: Column, rules: RuleSet) -> Column:
    """struct(decision, display, note): one row at a time, without a shuffle.

    The tests over the description come last and only run when the location itself decides nothing.
    """
    loc = strip(text_or_empty(location))
    norm = normalize_text(fold_place_spelling(loc, rules))
    home = place_matcher(rules.home_terms, rules)
    foreign = place_matcher(rules.foreign_terms, rules)
    generic = f"^(?:{alternation(rules.generic_places)})$"
    # a literal test rules most texts out before the pattern runs; a term that holds another needs no guard
    guards = tuple(t for t in rules.context_terms if not any(o != t and o in t for o in rules.context_terms))

    def named_in(text: Column) -> Column:
        return let(text, lambda low: F.exists(literal_array(guards), lambda g: F.contains(low, g)))

    in_context = f"(?iu){bounded(alternation(rules.context_terms))}"

    facts = F.struct(
        loc.alias("loc"), norm.alias("norm"), place_parts(loc, rules).alias("parts"),
        _choose([(label, lambda n, t=term: n == t) for term, label in rules.bare_regions], norm).alias("bare"))

    def has(f: Column, wanted: str) -> Column:
        return F.exists(f["parts"], lambda p: p["kind"] == wanted)

    def branch(f: Column) -> Column:
        names_home = f["norm"].rlike(home) | (f["norm"] == rules.home_code.lower())
        concrete = (f["loc"] != "") & ~f["norm"].rlike(generic)
        opening = normalize_text(description)
        if rules.context_chars is not None:
            opening = F.substring(opening, 1, rules.context_chars)
        return (F.when(f["bare"].isNotNull(), "bare")
                .when(has(f, HOME), "home")
                .when(has(f, EXCLUDED), "excluded")
                .when(has(f, FOREIGN) & ~names_home, "abroad")
                .when(names_home, "home")
                .when(F.coalesce(context, F.lit(False)) | text_or_empty(url).rlike(rules.home_url_pattern)
                      | (named_in(F.lower(text_or_empty(description))) & description.rlike(in_context)),
                      F.when(concrete, "inferred").otherwise("inferred_generic"))
                .when(concrete, "not_home")
                .when(opening.rlike(foreign), "context_abroad")
                .otherwise("unknown"))

    def outcome(f: Column, b: Column) -> Column:
        first_region = F.element_at(F.filter(f["parts"], lambda p: p["kind"] == EXCLUDED), 1)["region"]
        decision = (F.when(b.isin("bare", "excluded"), EXCLUDED)
                    .when(b.isin("home", "inferred", "inferred_generic"), HOME)
                    .when(b == "unknown", UNKNOWN).otherwise(FOREIGN))
        display = (F.when(b == "unknown", L.UNKNOWN_PLACE)
                   .when(b == "inferred_generic", F.when(f["loc"] == "", L.HOME_NAME_LOCAL).otherwise(
                       F.concat(F.lit(L.HOME_NAME_LOCAL + " ("), f["loc"], F.lit(")"))))
                   .otherwise(f["loc"]))
        note = (F.when(b == "bare", f["bare"]).when(b == "excluded", first_region)
                .when(b == "abroad", L.PLACE_ABROAD).when(b == "not_home", L.PLACE_NOT_HOME)
                .when(b == "context_abroad", L.PLACE_CONTEXT_ABROAD)
                .when(b.isin("inferred", "inferred_generic"), L.PLACE_INFERRED).otherwise(""))
        return F.struct(decision.alias("decision"), display.alias("display"), note.alias("note"))

    return let(facts, lambda f: let(branch(f), lambda b: outcome(f, b)))


@built_once
def title_says_abroad(title: Column, rules: RuleSet) -> Column:
    """The title itself names a foreign place or a relocation."""
    home = place_matcher(rules.home_terms, rules)
    foreign = place_matcher(rules.foreign_terms, rules)
    moving = "(?iu)" + "|".join(rules.relocation_words)
    return let(normalize_text(title), lambda n: F.when(n.rlike(foreign), True).when(n.rlike(home), False).otherwise(
        text_or_empty(title).rlike(moving)))


@built_once
def location_key(location: Column, rules: RuleSet) -> Column:
    """The first home term in a place without its trailing qualifier, else the normalised place."""
    home = f"(?<![{WORD}])({place_alternation(rules.home_terms, rules)})(?![{WORD}])"
    qualifier = rf" (?:{alternation(rules.place_qualifiers)})$"
    return let(normalize_text(location), lambda n: F.coalesce(
        F.regexp_replace(extract(n, home), qualifier, ""), n))
