"""One run: raw postings and the stored table in, report, state and audit out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import audit, cascade, cumulative, dedupe, discovery
from ..session import persisted
from ..sources import state
from ..vocab import RuleSet

# inputs of the cascade that nothing after it reads
TEXT_COLUMNS = ("description", "industry", "experience_hint", "home_context", "posted_raw", "updated_raw")


@dataclass
class Run:
    """The tables of a run, all written, and the numbers that were counted while they were."""

    evaluated: DataFrame
    kept: DataFrame
    new_jobs: DataFrame
    current: DataFrame
    retractions: DataFrame
    tally: DataFrame
    company_types: DataFrame
    counts: dict[str, int]

    @property
    def reasons(self) -> DataFrame:
        return audit.reasons_of(self.tally, self.current.sparkSession.createDataFrame([(self.counts["accepted"],)], "n long"))

    @property
    def removed(self) -> DataFrame:
        return self.current.sparkSession.createDataFrame([(self.counts["removed"],)], "removed long")


def _counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``persisted``, and what was counted in the same pass."""
    watch = Observation(name)
    table = persisted(df.observe(watch, *[F.count_if(condition).alias(key) for key, condition in counts.items()]), name)
    return table, dict(watch.get)


def _qualify(postings: DataFrame, as_of: Column, rules: RuleSet, subscriber_urls: DataFrame | None) -> tuple:
    """The part of a run that needs nothing stored: the cascade, its duplicates, sectors and retractions.

    The cascade runs once and is written without the texts; everything after it reads narrow columns of that table.
    What the texts tell about a company is decided in the same pass, for accepted rows only.
    """
    judged = cumulative.with_sector(cascade.evaluate(postings, as_of, rules), rules, F.col("accepted"))
    evaluated, raw = _counted(judged.drop(*TEXT_COLUMNS), "evaluated", raw=F.lit(True))
    kept, accepted = _counted(dedupe.greedy_dedupe(cascade.accepted_jobs(evaluated)), "kept", accepted=F.lit(True))
    typed = evaluated.where("accepted").join(kept.select("ord"), "ord", "left_semi")
    types = persisted(cumulative.strongest_company_type(typed, rules), "types")
    return evaluated, kept, types, cumulative.collect_retractions(evaluated, subscriber_urls), raw | accepted


def _merge(merged: DataFrame, as_of: Column, rules: RuleSet, evaluated: DataFrame, kept: DataFrame, types: DataFrame, retractions: DataFrame,
           counts: dict[str, int]) -> Run:
    """The merged table with its removals and sectors is written once; the table, the new rows and the counts come out of that pass."""
    marked = cumulative.mark_retracted(merged, retractions).withColumn("stays", ~F.col("retracted") & cumulative.is_fresh(as_of, rules))
    table, more = _counted(cumulative.apply_company_types(marked.drop("retracted"), types, rules), "table",
                           new=F.col("is_new"), cumulative=F.col("stays"), removed=~F.col("stays"))
    return Run(
        evaluated=evaluated, kept=kept,
        # new rows are reported even when a retraction of the same run removes them from the table
        new_jobs=table.where("is_new").drop("stays"), current=table.where("stays").drop("stays"), retractions=retractions,
        tally=persisted(audit.outcome_tally(evaluated), "tally"), company_types=types, counts=counts | more)


def run(postings: DataFrame, stored: DataFrame, as_of: Column, rules: RuleSet,
        subscriber_urls: DataFrame | None = None) -> Run:
    """One run on a stored table that is read as a whole."""
    evaluated, kept, types, retractions, counts = _qualify(postings, as_of, rules, subscriber_urls)
    return _merge(cumulative.upsert_cumulative(stored, kept, as_of, rules), as_of, rules, evaluated, kept, types, retractions, counts)


def run_on_state(postings: DataFrame, folder: str, as_of: Column, run_date: str, rules: RuleSet, subscriber_urls: DataFrame | None = None,
                 batch_id: int = -1, buckets: int = state.BUCKETS, completed_probes: DataFrame | None = None) -> Run | None:
    """One run on a state folder: only the buckets that it changes are read as a whole and written again.

    Postings find their rows by the identities of all stored rows, a narrow scan. A bucket changes where one of its rows is continued, added,
    retracted, expired, without a sector, or belongs to a company whose sector the run has seen. The new version is committed on the one that was
    read; if another run has been faster, the commit fails (``state.Superseded``) and what was written stays where it is. A run date that is
    committed already, or a batch no newer than the last one, changes nothing: the answer is None. Slugs probed in this
    run (slug) go into the cache of probes with the same commit. ``current`` of the answer has the changed buckets; the counts are of all.
    """
    spark = postings.sparkSession
    version = state.current_version(spark, folder)
    if version is not None and (version["batch_id"] >= batch_id >= 0 or batch_id < 0 and state.already_done(spark, folder, run_date)):
        return None
    buckets = version["buckets"] if version else buckets
    evaluated, kept, types, retractions, counts = _qualify(postings, as_of, rules, subscriber_urls)
    stored = state.read_state(spark, folder, version=version)
    matched = persisted(cumulative.match_existing(kept, stored, rules), "matched")
    company = cumulative.companies.company_key(F.col("company"), rules)
    narrow = stored.select("key", "date_iso", "company_type", company.alias("company_key"))
    changed = [matched.select(F.coalesce("stored_key", "key").alias("key")),
               narrow.join(retractions.select("key"), "key", "left_semi").select("key"),
               narrow.join(types.select("company_key"), "company_key", "left_semi").select("key"),
               narrow.where(~cumulative.is_fresh(as_of, rules) | cumulative.without_sector()).select("key")]
    touched = state.buckets_of(changed, buckets)
    merged = cumulative.apply_matches(state.read_state(spark, folder, touched, version), matched, as_of)
    result = _merge(merged, as_of, rules, evaluated, kept, types, retractions, counts)
    rest = sorted(set(range(buckets)) - set(touched))
    result.counts["cumulative"] += state.read_state(spark, folder, rest, version).count()
    tables = {}
    if completed_probes is not None:
        known = state.read_table(spark, folder, "probes", "slug string, probed_on date", version)
        tables["probes"] = discovery.probe_cache(known, completed_probes, as_of)
    state.write_state(result.current, folder, run_date, batch_id, base=version, touched=touched, buckets=buckets, tables=tables, run=result.counts)
    return result


def run_report(result: Run, statuses: DataFrame) -> dict[str, DataFrame]:
    from ..operators.report import report_tables

    return report_tables(result.new_jobs, result.current, audit.status_counts(statuses, result.kept))


def totals(result: Run, statuses: DataFrame) -> DataFrame:
    """(pos, item, n): the numbers of a run, as they were counted, and that of its links."""
    names = ("raw", "accepted", "new", "cumulative", "removed")
    rows = [(pos, name, result.counts[name]) for pos, name in enumerate(names)]
    links = statuses.agg(F.count("*").alias("n")).select(F.lit(len(names)).alias("pos"), F.lit("links").alias("item"), "n")
    return result.current.sparkSession.createDataFrame(rows, "pos int, item string, n long").unionByName(links)


def run_audit(result: Run, statuses: DataFrame) -> DataFrame:
    return audit.run_audit(totals(result, statuses), result.reasons, audit.places_of(result.tally))
