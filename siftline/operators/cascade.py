"""The qualification cascade: one narrow pass that gives every posting an outcome and its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions import companies, dates, places, text, titles
from ..functions.patterns import built_once, let, text_or_empty
from ..functions.staging import stage
from ..vocab import RuleSet


def role_essence(cls: Column, analytics: Column, engineering: Column) -> Column:
    """struct(ok, reason): whether analytics is what the role is about, by title class."""

    def verdict(ok: bool, reason: str) -> Column:
        return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))

    mostly = (analytics >= 3) & (analytics >= engineering)
    clearly = (analytics >= 5) & (analytics * 2 > engineering * 3) & (engineering <= 3)
    return (F.when(cls == titles.EXCLUDED, verdict(False, L.ESSENCE_EXCLUDED))
            .when((cls == titles.COMBINED) & mostly, verdict(True, L.ESSENCE_COMBINED_OK))
            .when(cls == titles.COMBINED, verdict(False, L.ESSENCE_COMBINED_NO))
            .when((cls == titles.LISTED) & (engineering >= 6) & (engineering > analytics * 2),
                  verdict(False, L.ESSENCE_LISTED_NO))
            .when(cls == titles.LISTED, verdict(True, L.ESSENCE_LISTED_OK))
            .when((cls == titles.VARIANT) & mostly, verdict(True, L.ESSENCE_VARIANT_OK))
            .when(cls == titles.VARIANT, verdict(False, L.ESSENCE_VARIANT_NO))
            .when((cls == titles.CANDIDATE) & clearly, verdict(True, L.ESSENCE_CANDIDATE_OK))
            .when(cls == titles.CANDIDATE, verdict(False, L.ESSENCE_CANDIDATE_NO))
            .otherwise(verdict(False, L.TITLE_NOT_RELEVANT)))


@built_once
def essence_of(cls: Column, low: Column, rules: RuleSet) -> Column:
    """``role_essence`` over the signals of a lower-cased description.

    The second list is only looked up where it can change the verdict: for a listed title the analytics
    signals matter from six engineering signals on, for the others engineering matters from three
    analytics signals on.
    """
    analytics, engineering = text.signal_score(low, rules.analytics), text.signal_score(low, rules.engineering)
    nothing = F.lit(0)
    listed = let(engineering, lambda e: let(
        F.when(e >= 6, analytics).otherwise(nothing), lambda a: role_essence(cls, a, e)))
    others = let(analytics, lambda a: let(
        F.when(a >= 3, engineering).otherwise(nothing), lambda e: role_essence(cls, a, e)))
    return F.when(cls == titles.LISTED, listed).otherwise(others)


def description_available(description: Column, rules: RuleSet) -> Column:
    return F.length(text_or_empty(description)) >= rules.min_description


def evaluate(postings: DataFrame, as_of: Column, rules: RuleSet) -> DataFrame:
    """Add the outcome of every posting.

    Added columns: title_class, accepted, outcome, seen_date; for accepted rows also the posting columns of the
    cumulative table (display values, key, alt_key, company_title). The work is staged: each test
    runs only on rows that passed the one before, so long texts of irrelevant titles are never scanned.
    """
    step = stage(postings, title_class=titles.title_class(F.col("title"), rules))
    step = stage(step, _open=titles.is_potential(F.col("title_class"))
                 & description_available(F.col("description"), rules))
    step = stage(step, _low=F.when(F.col("_open"), F.lower("description")))
    step = stage(step, keywords=F.when(F.col("_open"), text.find_keywords(F.col("_low"), rules)))
    step = stage(step, essence=F.when(F.size("keywords") > 0, essence_of(F.col("title_class"), F.col("_low"), rules)))
    fits = F.coalesce(F.col("essence.ok"), F.lit(False))
    step = stage(step, place=F.when(fits & places.title_says_abroad(F.col("title"), rules), F.struct(
        F.lit(places.FOREIGN).alias("decision"), F.lit("").alias("display"),
        F.lit(L.PLACE_TITLE_ABROAD).alias("note")))
        .when(fits, places.classify_location(
            F.col("location"), F.col("description"), F.col("url"), F.col("home_context"), rules)))
    placed = F.coalesce(F.col("place.decision").isin(places.HOME, places.UNKNOWN), F.lit(False))
    step = stage(step, seen_date=F.when(placed, dates.latest_date(
        [F.col("posted_raw"), F.col("updated_raw")], as_of, rules)))
    # unknown freshness is kept: only a known 'false' rejects
    fresh = F.coalesce(dates.freshness(F.col("seen_date"), as_of, rules.fresh_days), F.lit(True))
    step = stage(step, accepted=placed & fresh, outcome=(
        F.when(~titles.is_potential(F.col("title_class")), L.TITLE_NOT_RELEVANT)
        .when(~F.col("_open"), L.NO_DESCRIPTION)
        .when(F.size("keywords") == 0, L.NO_KEYWORD)
        .when(~F.col("essence.ok"), F.col("essence.reason"))
        .when(~placed, F.concat(F.lit(L.PLACE_PREFIX), F.when(
            F.col("place.note") == "", F.col("place.decision")).otherwise(F.col("place.note"))))
        .when(~fresh, L.TOO_OLD)
        .otherwise(L.ACCEPTED)))

    why = F.concat(
        F.col("essence.reason"), F.lit(L.KEYWORDS_PREFIX), F.array_join("keywords", ", "),
        F.when(F.col("place.note") != "", F.concat(F.lit("; "), F.col("place.note"))).otherwise(""),
        F.when(F.col("seen_date").isNull(), L.DATE_UNKNOWN_SUFFIX).otherwise(""))
    company = text.strip(text_or_empty(F.col("company")))
    shown = F.col("accepted")
    step = stage(
        step,
        job_title=text.strip(F.col("title")),
        job_company=F.when(company == "", L.UNKNOWN_COMPANY).otherwise(company),
        job_location=F.when(F.col("place.display") == "", L.UNKNOWN_PLACE).otherwise(F.col("place.display")),
        experience=F.when(shown, text.extract_experience(F.col("description"), F.col("experience_hint"), rules)),
        why=F.when(shown, why),
        date_display=F.when(shown, dates.date_display(F.col("seen_date"))),
        is_low_priority=F.coalesce(F.col("source").isin(*rules.low_priority_sources), F.lit(False)))
    keys = companies.job_keys(F.col("url"), F.col("job_company"), F.col("job_title"), F.col("job_location"), rules)
    step = stage(step, key=keys["key"], alt_key=F.when(shown, keys["alt_key"]),
                 company_title=F.when(shown, keys["company_title"]))
    return step.select(
        *postings.columns, "title_class", "accepted", "outcome", "seen_date", "job_title", "job_company",
        "job_location", "experience", "why", "date_display", "key", "alt_key", "company_title", "is_low_priority")


def accepted_jobs(evaluated: DataFrame) -> DataFrame:
    """Accepted rows with the columns of the cumulative table (first and last seen are set by the upsert)."""
    return evaluated.where("accepted").select(
        F.col("job_title").alias("title"), F.col("job_company").alias("company"), "source",
        F.col("job_location").alias("location"), "experience", F.col("why").alias("reason"), "url", "date_display",
        F.col("seen_date").alias("date_iso"), "key", "alt_key", "company_title", "is_low_priority", "listing_url", "ord")
