"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import unique_sites
from .cumulative import report_order

JOB_COLUMNS = ("title", "company_type", "company", "source", "location", "experience", "reason", "url", "date_display")
STATUS_COLUMNS = ("url", "site", "method", "status", "error", "count")
TABLES = {"new": JOB_COLUMNS, "cumulative": JOB_COLUMNS, "sources": STATUS_COLUMNS, "sites": ("site",)}


def report_tables(new_jobs: DataFrame, cumulative: DataFrame, statuses: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a report, in report order."""
    return {
        "new": report_order(new_jobs).select(*JOB_COLUMNS),
        "cumulative": report_order(cumulative).select(*JOB_COLUMNS),
        "sources": statuses.orderBy("ord").select(*STATUS_COLUMNS) if "ord" in statuses.columns
        else statuses.select(*STATUS_COLUMNS),
        "sites": unique_sites(statuses),
    }


def write_report(tables: dict[str, DataFrame], folder: str, run_date: str, csv: bool = False) -> None:
    """``<folder>/<table>/run_date=<date>``; also empty tables are written.

    The order of a table is one of ranges, and its files are numbered by them: read in the order of their names, they are the table in
    report order, and no task has more of it than its range. CSV files have a header each.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run_date={run_date}")
        if csv:
            df.write.mode("overwrite").csv(f"{folder}/csv/{name}/run_date={run_date}", header=True)


def report_verify(spark: SparkSession, folder: str, run_date: str, expected_new: int) -> bool:
    """Read the report back: all four tables, their columns, and the number of new rows."""
    for name, columns in TABLES.items():
        df = spark.read.parquet(f"{folder}/{name}/run_date={run_date}")
        if tuple(df.columns) != columns:
            raise ValueError(f"report table {name} has columns {df.columns}")
        if name == "new":
            rows = df.count()
            if rows != expected_new:
                raise ValueError(f"report holds {rows} new rows, expected {expected_new}")
    return True


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All report tables as one: table name and the row as one text."""
    out: DataFrame | None = None
    for name, df in tables.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        part = df.select(F.lit(name).alias("table_name"), F.concat_ws(" ¦ ", *cells).alias("row_text"))
        out = part if out is None else out.unionByName(part)
    return out


def prune_reports(spark: SparkSession, folder: str, keep: int = 30) -> list[str]:
    """Drop all but the last ``keep`` run dates of every report table; returns the dropped folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for name in TABLES:
        runs = sorted(s.getPath().toString() for s in fs.globStatus(path(f"{folder}/{name}/run_date=*")))
        for old in runs[:-keep] if keep else runs:
            fs.delete(path(old), True)
            dropped.append(old)
    return dropped
