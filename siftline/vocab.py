"""Vocabularies and switches.

Everything the rules look for is an input: a ``RuleSet`` can be built from a ``vocab`` table
(``rules_from_table``). ``starter_rules`` holds a small example set, so the pipeline runs out of the box.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from . import labels as L


@dataclass(frozen=True)
class Signal:
    """A pattern over lower-cased text.

    ``guards`` are literals of which at least one occurs in every match; they are tested first
    because a substring test is far cheaper than a regex. Without ``pattern`` the guards are the test.
    """

    label: str
    guards: tuple[str, ...]
    pattern: str = ""


def word(term: str) -> Signal:
    """A whole-word signal."""
    from .functions.patterns import whole

    return Signal(term, (term,), whole(term))


def part(*terms: str) -> Signal:
    """A signal that is found anywhere, also inside a word."""
    return Signal(terms[0], terms)


@dataclass(frozen=True)
class RuleSet:
    # titles
    listed_titles: tuple[str, ...]
    excluded_titles: tuple[str, ...]
    analyst_words: tuple[str, ...]
    role_words: tuple[str, ...]
    hard_stop_words: tuple[str, ...]
    blocked_title_words: tuple[str, ...]
    title_hints: tuple[str, ...]
    title_hint_words: tuple[str, ...]
    seniority_words: tuple[str, ...]
    feminine_forms: tuple[tuple[str, str], ...]
    # descriptions
    keywords: tuple[Signal, ...]
    implied_keywords: tuple[tuple[str, str], ...]
    analytics: tuple[Signal, ...]
    engineering: tuple[Signal, ...]
    privacy_guards: tuple[str, ...]
    privacy_pattern: str
    applicant_pattern: str
    not_keywords_guards: tuple[str, ...]
    not_keywords_pattern: str
    # places
    home_terms: tuple[str, ...]
    home_names: tuple[str, ...]
    home_code: str
    home_script: str
    excluded_regions: tuple[tuple[str, tuple[str, ...]], ...]
    bare_regions: tuple[tuple[str, str], ...]
    foreign_terms: tuple[str, ...]
    foreign_states: tuple[str, ...]
    generic_places: tuple[str, ...]
    nationwide_terms: tuple[str, ...]
    context_terms: tuple[str, ...]
    home_url_pattern: str
    relocation_words: tuple[str, ...]
    place_spelling: tuple[tuple[str, str], ...]
    place_qualifiers: tuple[str, ...]
    # companies
    company_suffixes: tuple[str, ...]
    sector_overrides: tuple[tuple[str, str], ...]
    hidden_pattern: str
    agency_pattern: str
    name_sectors: tuple[tuple[str, str], ...]
    industry_sectors: tuple[tuple[str, str], ...]
    tech_boards_pattern: str
    tech_words: tuple[str, ...]
    # ordered (guards, pattern): the first pattern that matches anywhere in a description tells the experience asked for
    experience: tuple[tuple[tuple[str, ...], str], ...]
    # switches
    low_priority_sources: tuple[str, ...] = ("Secret Tel Aviv",)
    fresh_days: int = 20
    min_description: int = 80
    context_chars: int | None = None
    business_zone: str = "Asia/Jerusalem"

    def with_(self, **changes) -> "RuleSet":
        return replace(self, **changes)


# Two-letter codes of the states and the district of the United States (public postal codes).
US_STATES = tuple(
    "AL,AK,AZ,AR,CA,CO,CT,DE,FL,GA,HI,ID,IL,IN,IA,KS,KY,LA,ME,MD,MA,MI,MN,MS,MO,MT,NE,NV,NH,NJ,NM,NY,NC,ND,OH,OK,"
    "OR,PA,RI,SC,SD,TN,TX,UT,VT,VA,WA,WV,WI,WY,DC".split(","))


def starter_rules() -> RuleSet:
    """A small set from one trade, gardening, that shows what each list is for.

    Lists for a real run are loaded with ``rules_from_table``.
    """
    from .functions.patterns import SPACE, WORD, bounded, whole

    # one blank; a run of line breaks is a sentence break and counts as one
    blank = rf"(?:\n+|{SPACE})"

    def craft(name: str) -> Signal:
        return Signal(name, (name.lower(),), whole(name.lower(), "a-z"))

    return RuleSet(
        listed_titles=("kitchen gardener", "market gardener", "orchard keeper", "rose gardener", "seed librarian", "שותל בוטני"),
        excluded_titles=("garden designer", "irrigation fitter", "landscape surveyor", "mower mechanic", "tree feller"),
        analyst_words=("gardener", "gardening", "שותל"),
        role_words=("gardener", "שותל"),
        hard_stop_words=("butcher", "fitter", "mechanic", "pilot", "surveyor", "טייס"),
        blocked_title_words=("captain", "foreman", "head", "steward", "מפקח"),
        title_hints=("botan", "garden", "horticult", "גינ"),
        title_hint_words=("bulbs", "soil"),
        seniority_words=("apprentice", "entry grade", "head", "jr", "junior", "senior"),
        feminine_forms=(("שותל", "ית"), ("ראשי", "ת")),
        keywords=(
            Signal("Grafting", ("graft",), rf"{whole('graft', 'a-z')}|{whole('grafting', 'a-z')}"),
            craft("Mulching"),
            craft("Pruning"),
            Signal("Pruning Saw", ("pruning",), rf"pruning{SPACE}+saws?"),
            Signal("Drip Irrigation", ("drip",), rf"drip{blank}?-?irrigation(?![a-z])"),
            part("Compost", "compost"),
            Signal("Seed Bank (בנק זרעים)", ("זרעים",), rf"בנקי?{blank}?-?זרעים"),
            part("Pruning (גיזום)", "גיזום"),
        ),
        implied_keywords=(("Pruning Saw", "Pruning"),),
        analytics=(part("bloom", "blossom"), part("greenhouse"), part("harvest"), part("hedge"),
                   Signal("herb", ("herb",), rf"{whole('herb')}|{whole('herbs')}"), word("mulch"), part("perennial"),
                   part("seedling"), word("soil"), part("שתיל")),
        engineering=(part("asphalt"), part("concrete"), word("crane"), word("diesel"), part("excavat"), part("scaffold"),
                     word("weld"), Signal("lay and repair", ("repair",),
                                          r"lay(?:ing)? and repair(?:ing)? (?:brick |stone )?(?:paths|walls)"),
                     part("בטון")),
        # every match of the privacy pattern holds one of these
        privacy_guards=("dpo", "personal", "privacy", "פרטי"),
        privacy_pattern=(r"(?iu)personal (?:file|record)s?|privacy (?:notice|rule)s?" rf"|{bounded('dpo')}"
                         r"|(?:תיק|תיקים) פרטי"),
        applicant_pattern=rf"(?iu)applicant|{bounded('apply|keep|kept')}|stor(?:e|ed|ing)|מועמד",
        not_keywords_guards=("budget",),
        not_keywords_pattern=rf"budget{SPACE}+pruning",
        home_terms=("beer sheva", "eilat", "haifa", "holon", "israel", "jerusalem", "nazareth", "ness ziona", "netanya",
                    "ramat gan", "rehovot", "rishon lezion", "tel aviv", "ישראל", "קריית", "רמת גן", "תל אביב"),
        home_names=("il", "israel", "ישראל"),
        home_code="IL",
        home_script="[א-ת]",
        excluded_regions=(
            (L.REGION_REHOVOT, ("rehovot",)),
            (L.REGION_RISHON, ("rishon lezion",)),
            (L.REGION_JERUSALEM, ("jerusalem",)),
            (L.REGION_NORTH, ("haifa", "nazareth", "קריית אתא")),
            (L.REGION_SOUTH, ("beer sheva", "eilat")),
        ),
        bare_regions=(("north", L.REGION_NORTH), ("south", L.REGION_SOUTH), ("דרום", L.REGION_SOUTH)),
        foreign_terms=("austria", "berlin", "canada", "france", "germany", "iceland", "london", "norway", "oslo", "paris",
                       "peru", "vienna"),
        foreign_states=US_STATES,
        generic_places=("anywhere", "hybrid", "remote", "various"),
        nationwide_terms=("nationwide", "כל הארץ"),
        context_terms=("israel", "tel aviv", "ישראל"),
        home_url_pattern=r"(?iu)\.il(?:[/:?#]|$)|[?&]land=il(?:&|$)",
        relocation_words=("relocating", "relocation"),
        place_spelling=(("קרית", "קריית"),),
        place_qualifiers=("district", "yafo"),
        company_suffixes=("group", "inc", "llc", "ltd", "בעמ"),
        sector_overrides=(("northbank", L.BANKS), ("quiet co", L.MEDIA)),
        hidden_pattern=r"(?iu)anonymous|hidden|undisclosed|^$",
        agency_pattern=rf"(?iu){bounded('agency|agencies')}|temp work",
        name_sectors=(
            (L.BANKS, bounded("bank")), (L.FINANCE, "insurance|pension"), (L.CONSULTING, "advis[eo]r"),
            (L.HEALTH, "clinic|hospital"), (L.MEDIA, "newspaper|radio"), (L.RETAIL, "foods?(?![a-z])|grocer"),
            (L.INDUSTRY, "foundry|shipyard"), (L.HITECH, rf"{bounded('cloud')}|robotic"),
        ),
        industry_sectors=(
            (L.AGENCY, "temporary work"), (L.BANKS, bounded("banking")), (L.FINANCE, "insurance"), (L.HEALTH, "nursing"),
            (L.RETAIL, "furniture|household|retail"), (L.INDUSTRY, "automobile|building|machinery"), (L.HITECH, "robotics"),
        ),
        # Hosts of recruiting systems.
        tech_boards_pattern=(r"(?iu)greenhouse\.io|lever\.co|ashbyhq\.com|comeet\.co|workable\.com"
                             r"|smartrecruiters\.com|myworkdayjobs\.com"),
        tech_words=(r"app store", bounded("beta"), r"open source", r"prototype"),
        experience=(
            (("season",), rf"(?iu)([0-9]+{SPACE}?-{SPACE}?[0-9]+{SPACE}+seasons)"),
            (("season",), rf"(?iu)((?:at least{SPACE}+)?[0-9]+\+?{SPACE}+seasons?)"),
            (("year",), rf"(?iu)([0-9]+\+?{SPACE}+years?(?:(?:{SPACE}+[{WORD}]+)?{SPACE}+outdoors)?)"),
            (("עונות",), rf"([0-9]+{SPACE}+עונות)"),
            (("beginners",), r"(?iu)(beginners welcome)"),
        ),
    )


_TERM_LISTS = {
    name for name, kind in RuleSet.__annotations__.items() if kind == "tuple[str, ...]"
}


def rules_from_table(vocab: DataFrame, base: RuleSet | None = None) -> RuleSet:
    """Replace term lists of ``base`` by the rows of a ``vocab`` table.

    ``list`` names a RuleSet field. Plain lists take ``term``; labelled lists take (label, terms).
    Patterns are compiled on the driver; a vocabulary too long for that is looked up with ``match_terms`` instead.
    """
    base = base or starter_rules()
    rows = vocab.orderBy("list", "priority", "term").toLocalIterator()
    by_list: dict[str, list] = {}
    for row in rows:
        by_list.setdefault(row["list"], []).append(row)
    changes: dict[str, object] = {}
    for name, terms in by_list.items():
        if name in _TERM_LISTS:
            changes[name] = tuple(r["term"] for r in terms)
        elif name == "excluded_regions":
            regions: dict[str, list[str]] = {}
            for r in terms:
                regions.setdefault(r["label"], []).append(r["term"])
            changes[name] = tuple((label, tuple(values)) for label, values in regions.items())
        elif name in ("keywords", "analytics", "engineering"):
            changes[name] = tuple(
                Signal(r["label"] or r["term"], () if r["is_regex"] else (r["term"].lower(),),
                       r["term"] if r["is_regex"] else "") for r in terms)
        elif name in ("name_sectors", "industry_sectors"):
            changes[name] = tuple((r["label"], r["term"]) for r in terms)
        elif name in ("sector_overrides", "bare_regions"):
            changes[name] = tuple((r["term"], r["label"]) for r in terms)
        else:
            raise ValueError(f"unknown vocabulary list: {name}")
    return base.with_(**changes)
