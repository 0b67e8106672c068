"""Link files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import link_identity
from ..operators.firsts import first_per_key

URL = r"https?://[^\s\p{Z}<>\"']+"
BARE_DOMAIN = r"(?i)^[\p{L}\p{N}_.\-]+\.[a-z]{2,}(?:/\S*)?$"


def read_link_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value): every .txt file of a folder as one row."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def link_list(files: DataFrame) -> DataFrame:
    """(path, line, pos, url): all links in file and line order.

    Blank and '#' lines are skipped; every address in a line counts, without closing punctuation;
    a line that is only a bare domain becomes an https address.
    """
    text = F.regexp_replace("value", "^\\uFEFF", "")
    lines = files.select("path", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "text"))
    lines = lines.withColumn("text", strip(F.col("text")))
    lines = lines.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    found = F.transform(F.regexp_extract_all("text", F.lit(URL), F.lit(0)),
                        lambda u: F.regexp_replace(u, r"[.,);\]]+$", ""))
    promoted = F.when(F.col("text").rlike(BARE_DOMAIN), F.array(F.concat(F.lit("https://"), F.col("text"))))
    links = F.when(F.col("text").rlike(URL), found).otherwise(promoted)
    return lines.select("path", "line", F.posexplode(links).alias("pos", "url"))


def link_dedupe_by_site(links: DataFrame) -> DataFrame:
    """The first link of every site; on hosts shared by many companies, of every address."""
    keyed = links.withColumn("identity", link_identity(F.col("url")))
    return first_per_key(keyed, ["identity"], F.struct("path", "line", "pos"))
