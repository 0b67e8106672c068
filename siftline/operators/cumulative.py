"""The cumulative table: match, upsert, retract, expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions import companies
from ..functions.dates import date_display, freshness
from ..functions.patterns import text_or_empty
from ..functions.urls import canonical_url
from ..schemas import POSTINGS_CURRENT, conform
from ..session import persisted
from ..vocab import RuleSet


def identities(stored: DataFrame, rules: RuleSet) -> DataFrame:
    """What stored rows are found by, narrow: key, alt_key, company and title, and what decides between equal ones."""
    title = companies.company_title_key(F.col("company"), F.col("title"), rules)
    return stored.select("key", "alt_key", title.alias("company_title"), "first_seen", "ord")


def match_existing(accepted: DataFrame, stored: DataFrame, rules: RuleSet) -> DataFrame:
    """``stored_key`` of the stored row a posting continues, null for a new one.

    Three equality joins instead of one join with OR: by key, else by alt_key, else - only for
    low-priority sources - by company and title. Of equal stored identities the last one counts.
    The accepted side is free of duplicates by key and alt_key, and stored rows are reduced to one
    per identity before the join, so no group grows. The third tier reads low-priority rows only.
    The stored rows' identities are written once for the three.
    """
    known = persisted(identities(stored, rules), "known")

    def last_by(identity: str) -> DataFrame:
        last = F.max(F.struct("first_seen", "ord", "key"))["key"]
        return known.groupBy(F.col(identity).alias(f"_{identity}")).agg(last.alias(f"by_{identity}"))

    out = accepted
    for identity in ("key", "alt_key"):
        side = last_by(identity)
        out = out.join(side, out[identity] == side[f"_{identity}"], "left").drop(f"_{identity}")
    side = last_by("company_title")
    # rows outside the third tier get a key of their own that matches nothing: equal (or null) keys
    # would send all of them to one task
    open_row = F.col("is_low_priority") & F.col("by_key").isNull() & F.col("by_alt_key").isNull()
    out = out.withColumn("_wanted", F.when(open_row, F.col("company_title")).otherwise(
        F.concat(F.lit("\u0000"), F.col("ord").cast("string"))))
    out = out.join(side, out["_wanted"] == side["_company_title"], "left").drop("_wanted", "_company_title")
    return (out.withColumn("stored_key", F.coalesce("by_key", "by_alt_key", "by_company_title"))
            .drop("by_key", "by_alt_key", "by_company_title"))


def upsert_cumulative(stored: DataFrame, accepted: DataFrame, as_of: Column, rules: RuleSet) -> DataFrame:
    """Stored rows brought up to date, plus the postings not seen before (``is_new``).

    Several postings can continue one stored row; as in arrival order, the newest date wins and the
    first known place and the first known experience fill a gap. Title, source, reason and address
    stay as first seen. ``key`` identifies a stored row; ``ord`` only orders the rows of one run.
    """
    return apply_matches(stored, persisted(match_existing(accepted, stored, rules), "matched"), as_of)


def apply_matches(stored: DataFrame, matched: DataFrame, as_of: Column) -> DataFrame:
    """``upsert_cumulative`` of postings whose ``stored_key`` is known; ``stored`` must have every row that one of them continues."""
    stored = conform(stored, POSTINGS_CURRENT)
    order = F.struct("is_low_priority", "ord")
    known_place = F.when(F.col("location") != L.UNKNOWN_PLACE, order)
    known_experience = F.when(text_or_empty(F.col("experience")) != "", order)
    updates = matched.where("stored_key is not null").groupBy("stored_key").agg(
        F.max("date_iso").alias("u_date"),
        F.min_by("location", known_place).alias("u_location"),
        F.min_by("experience", known_experience).alias("u_experience"))
    old = stored.join(updates, stored["key"] == updates["stored_key"], "left")
    newer = F.col("u_date").isNotNull() & (F.col("date_iso").isNull() | (F.col("u_date") > F.col("date_iso")))
    date = F.when(newer, F.col("u_date")).otherwise(F.col("date_iso"))
    continued = old.select(
        "title", "company", "source",
        F.when(F.col("location") == L.UNKNOWN_PLACE, F.coalesce("u_location", "location"))
        .otherwise(F.col("location")).alias("location"),
        F.when(F.col("experience") == "", F.coalesce("u_experience", "experience"))
        .otherwise(F.col("experience")).alias("experience"),
        "reason", "url",
        F.when(newer, date_display(F.col("u_date"))).otherwise(F.col("date_display")).alias("date_display"),
        date.alias("date_iso"), "key", "alt_key", "first_seen",
        F.when(F.col("stored_key").isNotNull(), as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        "company_type", "ord", F.lit(False).alias("is_new"))
    inserted = conform(matched.where("stored_key is null").withColumns(
        {"first_seen": as_of, "last_seen": as_of}), POSTINGS_CURRENT).withColumn("is_new", F.lit(True))
    return continued.unionByName(inserted)


def collect_retractions(evaluated: DataFrame, subscriber_urls: DataFrame | None = None) -> DataFrame:
    """Addresses that must leave the cumulative table.

    Too old: with the date seen. No keyword or a rejected place: without a date, so unconditional.
    Addresses open to subscribers only: without a date as well.
    """
    undated = (F.col("outcome") == L.NO_KEYWORD) | F.col("outcome").startswith(L.PLACE_PREFIX)
    too_old = F.col("outcome") == L.TOO_OLD
    out = evaluated.where(undated | too_old).select(
        "key", F.lit(None).cast("string").alias("alt_key"), F.when(too_old, F.col("seen_date")).alias("seen_date"))
    if subscriber_urls is not None:
        out = out.unionByName(subscriber_urls.select(
            canonical_url(F.col("url")).alias("key"), F.lit(None).cast("string").alias("alt_key"),
            F.lit(None).cast("date").alias("seen_date")))
    return out


def mark_retracted(current: DataFrame, retractions: DataFrame) -> DataFrame:
    """``current`` and ``retracted``: whether a retraction removes the row.

    A retraction counts when it has no date, when the stored date is unknown, or when it is not older
    than the stored date. Retractions are first reduced to one per key: undated beats the latest date.
    """
    reduced = retractions.where("key is not null").groupBy(F.col("key").alias("_key")).agg(
        F.max("seen_date").alias("_seen"), F.bool_or(F.col("seen_date").isNull()).alias("_always"))
    counts = F.col("_always") | F.col("date_iso").isNull() | (F.col("_seen") >= F.col("date_iso"))
    joined = current.join(reduced, current["key"] == reduced["_key"], "left")
    return joined.withColumn("retracted", F.coalesce(counts, F.lit(False)) & F.col("_key").isNotNull()).drop("_key", "_seen", "_always")


def retract_join(current: DataFrame, retractions: DataFrame) -> DataFrame:
    """Current rows that no retraction removes (see ``mark_retracted``)."""
    return mark_retracted(current, retractions).where("not retracted").drop("retracted")


def is_fresh(as_of: Column, rules: RuleSet) -> Column:
    """Whether a row is within the freshness window; rows without a date never expire."""
    return F.coalesce(freshness(F.col("date_iso"), as_of, rules.fresh_days), F.lit(True))


def expire_cumulative(current: DataFrame, as_of: Column, rules: RuleSet) -> DataFrame:
    """Rows within the freshness window; rows without a date never expire."""
    return current.where(is_fresh(as_of, rules))


def without_sector() -> Column:
    """Stored rows that no run has classified yet."""
    return text_or_empty(F.col("company_type")) == ""


def apply_company_types(current: DataFrame, run_types: DataFrame, rules: RuleSet) -> DataFrame:
    """This run's sector of a company wins; a stored row without one is classified by name and address."""
    empty = F.lit("")
    keyed = current.withColumn("company_key", companies.company_key(F.col("company"), rules))
    types = run_types.select(F.col("company_key").alias("_company"), F.col("company_type").alias("_run_type"))
    by_name = companies.company_sector(F.col("company"), empty, empty, F.col("url"), empty, rules)["type"]
    joined = keyed.join(types, keyed["company_key"] == types["_company"], "left")
    chosen = F.when(F.col("_run_type").isNotNull(), F.col("_run_type")).when(
        without_sector(), by_name).otherwise(F.col("company_type"))
    return joined.withColumn("company_type", chosen).drop("_company", "_run_type", "company_key")


def newest_first(current: DataFrame) -> list[Column]:
    """Sort key: newest date first, unknown dates last, then the latest first seen."""
    return [F.desc_nulls_last("date_iso"), F.desc("first_seen"), F.asc("ord")]


def report_order(current: DataFrame) -> DataFrame:
    """Sector order of the report, newest first inside a sector. The key is complete, so ties cannot move."""
    return current.orderBy(companies.sector_rank(F.col("company_type")), *newest_first(current))


def with_sector(postings: DataFrame, rules: RuleSet, wanted: Column | None = None) -> DataFrame:
    """Add ``sector``, what a posting says about its company; null where ``wanted`` doesn't hold."""
    from ..functions.staging import stage

    sector = companies.company_sector(
        F.col("company"), F.col("industry"), F.col("listing_url"), F.col("url"), F.col("description"), rules)
    return stage(postings, sector=sector if wanted is None else F.when(wanted, sector))


def strongest_company_type(postings: DataFrame, rules: RuleSet, company: str = "job_company") -> DataFrame:
    """One sector per company: the strongest signal of its postings, ties to the first posting.

    Postings that have their ``sector`` already need no text.
    """
    judged = postings if "sector" in postings.columns else with_sector(postings, rules)
    judged = judged.select(
        companies.company_key(F.col(company), rules).alias("company_key"),
        F.col("sector.type").alias("type"), companies.strength_rank(F.col("sector.strength")).alias("strength"),
        "is_low_priority", "ord")
    best = F.max_by("type", F.struct(
        F.col("strength"), (-F.col("is_low_priority").cast("int")).alias("low"), (-F.col("ord")).alias("o")))
    return judged.groupBy("company_key").agg(best.alias("company_type"))
