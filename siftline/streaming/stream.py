"""The same semantics as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import canonical_url
from ..plans.daily_run import run_on_state
from ..vocab import RuleSet


def stream_upsert(postings: DataFrame, state_folder: str, checkpoint: str, as_of: Callable[[DataFrame], Column],
                  run_date: str, rules: RuleSet) -> StreamingQuery:
    """Upsert the cumulative table once per micro-batch, each of which is a run.

    A posting continues a row by any of three identities, which no single key of a keyed state has; so each batch finds its rows by the identities
    of all and reads and writes only the buckets that it changes (see ``run_on_state``). A batch that was already applied is skipped by its id, which
    is part of the commit, so a restart between the write and the commit of the stream changes nothing; rows whose date is too old
    leave with the next batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        run_on_state(batch, state_folder, as_of(batch), run_date, rules, batch_id=batch_id)

    return (postings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_visit_once(visits: DataFrame, time: str = "ts", url: str = "url", horizon: str = "20 days") -> DataFrame:
    """Each canonical address once; late repeats are dropped within the horizon."""
    keyed = visits.withColumn("url_key", canonical_url(F.col(url)))
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["url_key"])
