"""The fetch log: what happened to every link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..schemas import POSTINGS_RAW, SOURCE_STATUS, conform
from ..session import persisted

# Answer codes that mean 'unreachable', by family of sources.
UNREACHABLE_CODES = {"page": (401, 403, 404), "board": (404,), "search": (403, 999), "guarded": (401, 403)}

#: Ordinals of one source lie below this.
SOURCE_STEP = 1 << 56


def _unreachable(family: Column, code: Column) -> Column:
    return reduce(lambda a, b: a | b, [(family == f) & code.isin(*codes) for f, codes in UNREACHABLE_CODES.items()])


def link_status(log: DataFrame) -> DataFrame:
    """(url, status, error) per link of a fetch log (url, family, page, code, in_time).

    An error on the first page decides; one on a later page makes the link partial. A link whose first page
    was not reached in time is partial and not scanned; a later page not reached in time stops it there.
    ``code`` is 200 for a page that was read.
    """
    late = ~F.col("in_time")
    # without a code the page was never asked for
    failed = F.when(late | (F.col("code") != 200), F.struct("page", F.when(~late, F.col("code")).alias("code"), "family"))
    first = log.groupBy("url").agg(
        F.min(F.when(F.col("page") == 1, failed)).alias("head"),
        F.min(F.when(F.col("page") > 1, failed)).alias("later"))
    unread = F.col("head").isNotNull() & F.col("head.code").isNull()

    def message(failure: str) -> Column:
        return F.coalesce(F.concat(F.lit("HTTP "), F.col(f"{failure}.code").cast("string")), F.lit(L.TIME_OVER))

    return first.select(
        "url",
        F.when(unread, L.PARTIAL)
        .when(F.col("head").isNotNull(), F.when(
            _unreachable(F.col("head.family"), F.col("head.code")), L.UNREACHABLE).otherwise(L.FAILED))
        .when(F.col("later").isNotNull(), L.PARTIAL).otherwise(L.OK).alias("status"),
        F.when(unread, L.NOT_SCANNED)
        .when(F.col("head").isNotNull(), message("head"))
        .when(F.col("later").isNotNull(), F.concat(
            F.lit(L.STOPPED_AT_PAGE + " "), F.col("later.page").cast("string"), F.lit(": "), message("later")))
        .otherwise("").alias("error"))


def _by_file(rows: DataFrame) -> DataFrame:
    """Rows of a table of files, numbered by where they stand: the path of the file, the row in it."""
    from .landing import file_offsets

    columns = rows.columns
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = rows.select("*", at.alias("_at"))
    offsets = persisted(file_offsets(placed), "files")
    joined = placed.join(offsets, F.col("_at.file") == offsets["file"])
    return joined.select(*columns, (F.col("before") + F.col("_at.row")).alias("ord"))


def union_sources(sources: dict[str, object], template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All readable sources as one posting table, and one status row per source, or file of it, that could not be read.

    ``sources`` maps a name to a function returning a DataFrame, or a pair of one and the status rows of what it had to leave out
    (see ``quarantine``). A source that can't even be planned (a missing path, an unknown column) is a failed one.
    ``ord`` is unique and the same in every run: the source's place in ``sources``, then its own ``ord``; a source without
    one must be read from Parquet files, and its rows stand as they do there.
    """
    spark = template.sparkSession
    out, statuses, broken = conform(template, POSTINGS_RAW).limit(0), spark.createDataFrame([], SOURCE_STATUS), []
    for place, (name, read) in enumerate(sources.items()):
        try:
            found = read()
            rows, left_out = found if isinstance(found, tuple) else (found, None)
            if "ord" not in rows.columns:
                rows = _by_file(rows)
            out = out.unionByName(conform(rows.withColumn("ord", F.lit(place * SOURCE_STEP) + F.col("ord")), POSTINGS_RAW))
            if left_out is not None:
                statuses = statuses.unionByName(left_out.select(*SOURCE_STATUS.names))
        except Exception as error:  # noqa: BLE001 - one broken source must not stop the run
            text = f"{type(error).__name__}: {str(error).splitlines()[0]}"
            broken.append((f"internal://{name}", name, "", L.FAILED, text, 0, []))
    return out, statuses.unionByName(spark.createDataFrame(broken, SOURCE_STATUS))


def only_sources(postings: DataFrame, group: str, wanted: tuple[str, ...]) -> DataFrame:
    """Restrict a run to named source groups; no names means all."""
    return postings.where(F.col(group).isin(*wanted)) if wanted else postings
