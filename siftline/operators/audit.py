"""Counts and audit tables of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.patterns import text_or_empty
from ..functions.text import strip


def outcome_tally(evaluated: DataFrame) -> DataFrame:
    """(outcome, location, n, first): rows per outcome, and of those rejected as abroad per place text, with the first of them.

    What ``reason_counts`` and ``foreign_location_audit`` say, from one pass over the evaluated rows.
    """
    abroad = F.col("outcome").startswith(L.PLACE_PREFIX + L.PLACE_NOT_HOME) | F.col("outcome").startswith(L.PLACE_PREFIX + "מחוץ")
    return evaluated.groupBy("outcome", F.when(abroad, F.col("location")).alias("location")).agg(
        F.count("*").alias("n"), F.min(F.when(abroad, F.struct("is_low_priority", "ord"))).alias("first"))


def reasons_of(tally: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows per outcome; duplicates are an extra row on top of their 'accepted' count. ``survivors`` (n) is one row, the accepted rows that were kept."""
    counts = tally.groupBy(F.col("outcome").alias("reason")).agg(F.sum("n").alias("n"))
    passed = counts.where(F.col("reason") == L.ACCEPTED).select("n")
    duplicates = passed.unionByName(survivors.select((-F.col("n")).alias("n"))).agg(F.sum("n").alias("n")).where("n > 0")
    return counts.unionByName(duplicates.select(F.lit(L.DUPLICATE).alias("reason"), "n"))


def places_of(tally: DataFrame, limit: int | None = None) -> DataFrame:
    """The most frequent place texts rejected as abroad; ties to the one seen first."""
    abroad = tally.where("first is not null").groupBy("location").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ordered = abroad.orderBy(F.desc("n"), "first")
    return (ordered if limit is None else ordered.limit(limit)).drop("first")


def reason_counts(evaluated: DataFrame, kept: DataFrame) -> DataFrame:
    """``reasons_of`` a table of evaluated rows and the accepted ones that were kept."""
    return reasons_of(outcome_tally(evaluated), kept.agg(F.count("*").alias("n")))


def foreign_location_audit(evaluated: DataFrame, limit: int | None = None) -> DataFrame:
    """``places_of`` a table of evaluated rows."""
    return places_of(outcome_tally(evaluated), limit)


def company_first_site(sightings: DataFrame) -> DataFrame:
    """Company name to the first site it was seen on (names under 80 characters)."""
    named = sightings.withColumn("company", strip(text_or_empty(F.col("company"))))
    named = named.where((F.col("company") != "") & (F.length("company") < 80))
    return named.groupBy("company").agg(F.min_by("site", "ord").alias("site"), F.min("ord").alias("ord"))


def status_rollup(statuses: DataFrame) -> DataFrame:
    """How many links were read, partly read, or not read."""
    ok, partial = F.col("status") == L.OK, F.col("status") == L.PARTIAL
    return statuses.agg(F.count_if(ok).alias("ok"), F.count_if(partial).alias("partial"),
                        F.count_if(~ok & ~partial).alias("failed"))


def unique_sites(statuses: DataFrame) -> DataFrame:
    """Sites with at least one link read, once each in their first spelling, sorted."""
    read = statuses.where(F.col("status").isin(L.OK, L.PARTIAL) & (F.col("site") != "")
                          & ~text_or_empty(F.col("error")).startswith(L.NOT_SCANNED.split(" -")[0]))
    for tool in L.DISCOVERY_SITES:
        read = read.where(~F.col("site").startswith(tool))
    return (read.groupBy(F.lower("site").alias("_low")).agg(F.min_by("site", "ord").alias("site"))
            .orderBy("_low").select("site"))


def joined_notes(notes: Column, width: int = 500) -> Column:
    """Distinct notes in order as one text."""
    return F.substring(F.array_join(F.array_distinct(notes), "; "), 1, width)


def status_notes(links: DataFrame, notes: DataFrame, width: int = 500) -> DataFrame:
    """Status and error text per link.

    ``links``: url, failure status and message (null when the link did not fail), and ``failed_at``, the failure's
    place among the notes. ``notes``: url, note, ord. A note turns 'ok' into 'partial'. A failure stays one; its own text
    gives way to the notes if one comes after it.
    Notes are reduced to the distinct texts of a link, each at its first position. Every note takes at
    least one character of the text, so the first ``width`` notes always fill it; the rank limit is
    applied on the map side too, and a link with very many notes never fills one task.
    """
    distinct = notes.groupBy("url", "note").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("url").orderBy("ord", "note"))
    distinct = distinct.where(F.col("note") != "").withColumn("_n", place).where(F.col("_n") <= width)
    listed = distinct.groupBy(F.col("url").alias("_url")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda n: n["note"]).alias("notes"))
    last = notes.where(F.col("note") != "").groupBy(F.col("url").alias("_url")).agg(F.max("ord").alias("last"))
    joined = links.join(listed.join(last, "_url"), links["url"] == F.col("_url"), "left").drop("_url")
    failed = F.col("failure").isNotNull()
    final = failed & ~F.coalesce(F.col("last") > F.col("failed_at"), F.lit(False))
    return joined.select(
        "url",
        F.when(failed, F.col("failure")).when(F.col("notes").isNotNull(), L.PARTIAL).otherwise(L.OK).alias("status"),
        F.when(final, F.col("message")).when(F.col("notes").isNotNull(), joined_notes(F.col("notes"), width))
        .otherwise("").alias("error"))


def status_counts(statuses: DataFrame, kept: DataFrame) -> DataFrame:
    """Accepted rows per listing address on every status row; 0 where there are none."""
    counts = kept.groupBy(F.col("listing_url").alias("_listing")).agg(F.count("*").alias("count"))
    base = statuses.drop("count")
    return (base.join(counts, base["url"] == counts["_listing"], "left").drop("_listing")
            .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint"))))


def removed_count(upserted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Rows that were retracted or expired, each counted once."""
    before = upserted.agg(F.count("*").alias("n"))
    after = remaining.agg((-F.count("*")).alias("n"))
    return before.unionByName(after).agg(F.sum("n").alias("removed"))


def run_audit(totals: DataFrame, reasons: DataFrame, abroad: DataFrame) -> DataFrame:
    """One row: a map of totals, outcomes and places. The inputs are small: one row per total and
    outcome, and the capped audit list."""
    def entries(df: DataFrame, part: str, name: str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(name).alias("name"), F.col("n").cast("bigint").alias("n"))

    def collected(part: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(
            F.when(F.col("part") == part, F.struct("name", "n")))))

    rows = entries(totals, "totals", "item").unionByName(entries(reasons, "reasons", "reason")).unionByName(
        entries(abroad, "abroad", "location"))
    audit = rows.agg(collected("totals").alias("totals"), collected("reasons").alias("reasons"),
                     collected("abroad").alias("locations_treated_as_abroad"))
    return audit.select(
        *[F.col("totals")[name].alias(name) for name in ("raw", "accepted", "new", "cumulative", "removed", "links")],
        "reasons", "locations_treated_as_abroad")


def summary_table(totals: DataFrame, reasons: DataFrame) -> DataFrame:
    """Headline numbers first, then the outcomes by count."""
    headline = totals.select(F.lit(0).alias("part"), "item", "n", F.col("pos").cast("bigint").alias("pos"))
    outcomes = reasons.select(F.lit(1).alias("part"), F.col("reason").alias("item"), "n", (-F.col("n")).alias("pos"))
    return (headline.unionByName(outcomes).orderBy("part", "pos", "item")
            .select(F.when(F.col("part") == 0, "total").otherwise("reason").alias("section"), "item", "n"))


def history_tail(history: DataFrame, keep: int) -> DataFrame:
    """The last runs, oldest first."""
    return history.orderBy(F.desc("run_date"), F.desc("run_id")).limit(keep).orderBy("run_date", "run_id")
