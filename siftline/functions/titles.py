"""Title classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import RuleSet
from .patterns import alternation, built_once, let, text_or_empty, word_matcher
from .text import fold_gender, normalize_text, normalize_title

LISTED, VARIANT, COMBINED, EXCLUDED, CANDIDATE = "listed", "variant", "combined", "excluded", "candidate"
POTENTIAL = (LISTED, VARIANT, COMBINED, CANDIDATE)

_normal_cache: dict[tuple, tuple[str, ...]] = {}


def normal_terms(terms: tuple[str, ...], rules: RuleSet) -> tuple[str, ...]:
    """Vocabulary terms in the same normal form as the titles they are looked up in."""
    import re

    key = (terms, rules.seniority_words)
    if key not in _normal_cache:
        senior = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, rules.seniority_words)) + r")(?!\w)")
        folded = []
        for term in terms:
            for base, suffix in rules.feminine_forms:
                term = re.sub(rf"({base}){suffix}(?!\w)", r"\1", term)
            term = re.sub(r"[/\\\-–—&_,|()\[\]:;+.!?]", " ", re.sub("[\"'`׳״]", "", term.lower()))
            folded.append(" ".join(senior.sub(" ", re.sub(r"\band\b", " ", term)).split()))
        _normal_cache[key] = tuple(dict.fromkeys(t for t in folded if t))
    return _normal_cache[key]


@built_once
def title_class(title: Column, rules: RuleSet) -> Column:
    """listed / variant / combined / excluded / candidate, or null.

    Excluded phrases are taken out first; only what is left can make a title an analyst title.
    """
    listed = word_matcher(normal_terms(rules.listed_titles, rules))
    excluded = word_matcher(normal_terms(rules.excluded_titles, rules))
    analyst = word_matcher(rules.analyst_words)
    role = word_matcher(rules.role_words)
    stop = word_matcher(rules.hard_stop_words)
    blocked = "(?iu)" + word_matcher(rules.blocked_title_words)
    hints = alternation(rules.title_hints) + "|" + word_matcher(rules.title_hint_words)
    full = normalize_text(fold_gender(title, rules))

    def classify(pair: Column) -> Column:
        text, rest = pair["text"], pair["rest"]
        has_excluded = text != rest
        return (
            F.when(has_excluded & (rest.rlike(listed) | rest.rlike(role)), COMBINED)
            .when(has_excluded, EXCLUDED)
            .when(rest.rlike(listed), LISTED)
            .when(rest.rlike(analyst), VARIANT)
            # rank words count here, so the title is tested before they are stripped
            .when(text.rlike(hints) & ~text.rlike(stop) & ~full.rlike(blocked), CANDIDATE))

    return let(normalize_title(text_or_empty(title), rules), lambda text: let(
        F.struct(text.alias("text"), F.regexp_replace(text, excluded, " ").alias("rest")), classify))


def is_potential(cls: Column) -> Column:
    return F.coalesce(cls.isin(*POTENTIAL), F.lit(False))


