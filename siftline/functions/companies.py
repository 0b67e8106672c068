"""Company expressions: key and sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels as L
from ..vocab import RuleSet
from .patterns import WORD, built_once, let, text_or_empty, word_matcher
from .places import location_key
from .text import normalize_text, strip
from .urls import canonical_url


@built_once
def company_key(company: Column, rules: RuleSet) -> Column:
    """A company name without legal forms, filler words and separators."""
    bare = F.regexp_replace(normalize_text(company), word_matcher(rules.company_suffixes), " ")
    return F.regexp_replace(bare, f"[^{WORD}]", "")


@built_once
def company_title_key(company: Column, title: Column, rules: RuleSet) -> Column:
    return F.concat_ws("|", company_key(company, rules), normalize_text(title))


@built_once
def job_keys(url: Column, company: Column, title: Column, location: Column, rules: RuleSet) -> dict[str, Column]:
    """key = address; alt_key = company, title and place; company_title = the third tier."""
    return {
        "key": canonical_url(url),
        "alt_key": F.concat_ws("|", company_key(company, rules), normalize_text(title),
                               location_key(location, rules)),
        "company_title": company_title_key(company, title, rules),
    }


@built_once
def company_sector(company: Column, industry: Column, listing_url: Column, url: Column, description: Column,
                   rules: RuleSet) -> Column:
    """struct(type, strength) from the strongest signal of one posting; the rules are tried in order."""

    def decide(f: Column) -> Column:
        name, plain, low = f["name"], f["plain"], f["low"]

        def found(sector: str, strength: str) -> Column:
            return F.struct(F.lit(sector).alias("type"), F.lit(strength).alias("strength"))

        result = None
        for exact, sector in rules.sector_overrides:
            test = low == exact
            result = F.when(test, found(sector, "override")) if result is None else result.when(
                test, found(sector, "override"))
        hidden = name.rlike(rules.hidden_pattern) | name.rlike(rules.agency_pattern)
        result = F.when(hidden, found(L.AGENCY, "hidden")) if result is None else result.when(
            hidden, found(L.AGENCY, "hidden"))
        for sector, pattern in rules.name_sectors:
            result = result.when(low.rlike(pattern) | plain.rlike(pattern), found(sector, "name"))
        for sector, pattern in rules.industry_sectors:
            result = result.when(f["industry"].rlike(pattern), found(sector, "industry"))
        boards = rules.tech_boards_pattern
        result = result.when(text_or_empty(listing_url).rlike(boards) | text_or_empty(url).rlike(boards),
                             found(L.HITECH, "ats"))
        words = F.lit(0)
        for pattern in rules.tech_words:
            words = words + F.lower(text_or_empty(description)).rlike(pattern).cast("int")
        return result.when(words >= 2, found(L.HITECH, "description")).otherwise(found(L.OTHER, "none"))

    name = strip(text_or_empty(company))
    return let(F.struct(name.alias("name"), F.lower(name).alias("low"), normalize_text(name).alias("plain"),
                        F.lower(text_or_empty(industry)).alias("industry")), decide)


def strength_rank(strength: Column) -> Column:
    expr = None
    for name, value in L.STRENGTH.items():
        expr = F.when(strength == name, value) if expr is None else expr.when(strength == name, value)
    return expr


def sector_rank(sector: Column) -> Column:
    """Report position of a sector; an unknown one ranks as 'other'."""
    expr = None
    for position, name in enumerate(L.SECTOR_ORDER):
        expr = F.when(sector == name, position) if expr is None else expr.when(sector == name, position)
    return expr.otherwise(L.SECTOR_ORDER.index(L.OTHER))
