"""Files and rows that can't be read: set aside with a failed status, the rest of the source goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..session import persisted

CORRUPT = "_corrupt_record"
PARQUET_MARK = "PAR1"  # the last bytes of every whole Parquet file


def _has_footer(content: Column, length: Column) -> Column:
    """Whether the file ends in the length of a footer that fits into it, and the mark."""
    digits = F.hex(F.substring(content, -8, 4))  # little-endian
    size = F.conv(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.coalesce((F.substring(content, -4, 4) == F.lit(PARQUET_MARK).cast("binary")) & (size + 12 <= length), F.lit(False))


def sound_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the rows of all files under ``path`` that have a footer, and (file, reason) of the others.

    Three steps, none of which reads the rows: the files as the store lists them; those whose footer gives rows; of the rest, which may also be
    whole but empty, the last bytes. The bad files, a short list, are then left out by name, so a scan never opens them. A file that is
    damaged behind a good footer still fails the job that reads it, with its name, rather than lose rows unseen.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true")
    rows = (reader.schema(schema) if schema is not None else reader).parquet(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    answered = rows.groupBy(F.col("_metadata.file_path").alias("file")).count()
    silent = persisted(files.select("path").join(answered, F.col("path") == F.col("file"), "left_anti"), "silent")
    checked = files.join(silent, "path", "left_semi") if silent.take(1) else files.limit(0)
    bad = persisted(checked.where(~_has_footer(F.col("content"), F.col("length"))).select(
        F.col("path").alias("file"), F.lit("no Parquet footer").alias("reason")), "bad")
    names = [row[0] for row in bad.select("file").collect()]
    strict = spark.read.schema(rows.schema).parquet(path)
    return strict.where(~F.col("_metadata.file_path").isin(names)) if names else strict, bad


def sound_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of JSON lines that fit ``schema``, with their ``file``, and (file, reason, record) of the lines that don't."""
    text = spark.read.text(path)
    wide = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    parsed = text.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    broken = F.col(f"r.{CORRUPT}").isNotNull()
    return (parsed.where(~broken).select("file", *[f"r.{name}" for name in schema.names]),
            parsed.where(broken).select("file", F.lit("no JSON of the schema").alias("reason"), F.col("value").alias("record")))


def failed_files(bad: DataFrame, source: str) -> DataFrame:
    """One failed status row for each file that has something set aside."""
    found = bad.groupBy("file", "reason").agg(F.count("*").alias("n"))
    return found.select(F.col("file").alias("url"), F.lit(source).alias("site"), F.lit("").alias("method"), F.lit(L.FAILED).alias("status"),
                        F.concat("reason", F.lit(": "), F.col("n").cast("string")).alias("error"), F.lit(0).cast("long").alias("count"),
                        F.array().cast("array<string>").alias("notes"))
