"""The cumulative table on disk: buckets that are never overwritten, and one small file for each version that says which of them it has."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import POSTINGS_CURRENT, conform

COMMITS = "_commits"
BUCKETS = 64
BUCKET = "_bucket"


class Superseded(RuntimeError):
    """Another writer has committed the version that this one was to become; what was written is still there."""


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(keys: list[DataFrame], buckets: int) -> list[int]:
    """The buckets that hold any of the keys."""
    found = [df.select(bucket(F.col("key"), buckets).alias(BUCKET)).distinct() for df in keys]
    return sorted(row[0] for row in reduce(DataFrame.unionByName, found).distinct().collect())


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _fs(spark, pattern)
    return sorted(found.getPath().toString() for found in fs.globStatus(path(pattern)) or [])


def current_version(spark: SparkSession, folder: str) -> dict | None:
    """The last commit of a state folder: number, run_date, batch_id, buckets, paths of them; None when there is none."""
    commits = _listed(spark, f"{folder}/{COMMITS}/[0-9]*.json")
    if not commits:
        return None
    fs, path = _fs(spark, folder)
    stream = fs.open(path(commits[-1]))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, run_date, batch_id, raw, accepted, new, cumulative, removed): one row per commit; what a run didn't count is null."""
    schema = ("number long, run_date date, batch_id long, run struct<raw: long, accepted: long, new: long, cumulative: long, removed: long>")
    if not _listed(spark, f"{folder}/{COMMITS}/[0-9]*.json"):
        return spark.createDataFrame([], schema).select(F.col("number").alias("run_id"), "run_date", "batch_id", "run.*")
    commits = spark.read.schema(schema).option("pathGlobFilter", "[0-9]*.json").json(f"{folder}/{COMMITS}")
    return commits.select(F.col("number").alias("run_id"), "run_date", "batch_id", "run.*")


def already_done(spark: SparkSession, folder: str, run_date: str) -> bool:
    return not history(spark, folder).where(F.col("run_date") == F.lit(run_date).cast("date")).isEmpty()


def read_state(spark: SparkSession, folder: str, buckets: list[int] | None = None, version: dict | None = None) -> DataFrame:
    """The rows of a version (the current one, if none is given), or of some of its buckets; an empty table when there are none."""
    version = version or current_version(spark, folder)
    paths = [path for number, path in (version or {"paths": {}})["paths"].items() if buckets is None or int(number) in buckets]
    if not paths:
        return spark.createDataFrame([], POSTINGS_CURRENT)
    return conform(spark.read.schema(POSTINGS_CURRENT).parquet(*paths), POSTINGS_CURRENT)


def read_table(spark: SparkSession, folder: str, name: str, schema: str, version: dict | None = None) -> DataFrame:
    """A small table that is kept with the state, empty when no version has it."""
    path = ((version or current_version(spark, folder) or {}).get("tables") or {}).get(name)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def parse_state(records: DataFrame, column: str = "json") -> DataFrame:
    """Stored rows kept as JSON texts: unknown fields are dropped, missing ones take their default."""
    loose = T.StructType([f for f in POSTINGS_CURRENT])
    return conform(records.select(F.from_json(column, loose).alias("r")).select("r.*"), POSTINGS_CURRENT)


def write_state(current: DataFrame, folder: str, run_date: str, batch_id: int = -1, base: dict | None = None, touched: list[int] | None = None,
                buckets: int = BUCKETS, tables: dict[str, DataFrame] | None = None, run: dict[str, int] | None = None) -> int:
    """Commit a version in which the ``touched`` buckets (all, if not given) hold the rows of ``current``; the others are those of ``base``.

    ``base`` is the version that was read (with neither it nor ``touched``: the last one). The commit is a file that is made under the next
    number and must not be there yet, so of two writers on one base one gets ``Superseded``. The file system must refuse to rename onto
    a file that exists, as HDFS does. Returns the number.
    """
    spark = current.sparkSession
    if base is None and touched is None:
        base = current_version(spark, folder)
    buckets = base["buckets"] if base else buckets
    rows = conform(current, POSTINGS_CURRENT).withColumn(BUCKET, bucket(F.col("key"), buckets))
    if touched is not None:
        rows = rows.where(F.col(BUCKET).isin(touched))
    data = f"{folder}/data/{uuid.uuid4().hex}"
    rows.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(data)
    paths = {number: path for number, path in (base or {"paths": {}})["paths"].items() if touched is not None and int(number) not in touched}
    new = {path.rsplit("=", 1)[1]: path for path in _listed(spark, f"{data}/{BUCKET}=*")}
    paths |= new
    kept = dict((base or {}).get("tables") or {})
    for name, df in (tables or {}).items():
        kept[name] = f"{folder}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(kept[name])
    record = {"number": base["number"] + 1 if base else 0, "run_date": run_date, "batch_id": batch_id, "buckets": buckets, "paths": paths, "tables": kept,
              "run": run, "written": sorted(new)}
    _commit(spark, folder, record)
    return record["number"]


def _commit(spark: SparkSession, folder: str, record: dict) -> None:
    fs, path = _fs(spark, folder)
    draft, target = path(f"{folder}/{COMMITS}/.draft-{uuid.uuid4().hex}"), path(f"{folder}/{COMMITS}/{record['number']:012d}.json")
    out = fs.create(draft, False)
    out.write(json.dumps(record).encode())
    out.close()
    hadoop, configuration = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    scheme = target.toUri().getScheme()
    context = hadoop.FileContext.getFileContext(target.toUri(), configuration) if scheme else hadoop.FileContext.getFileContext(configuration)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception):
            raise Superseded(f"version {record['number']} of {folder} is there already; the rows of this run stay under {folder}/data") from None
        raise
