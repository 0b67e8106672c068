"""The corpus pipeline: documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import line_dedup, quality, simhash, sum_squares
from siftline.llm.tables import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own score, whatever its id. The rows' number has a name that no column has."""
    row = "row_" + max(docs.columns, key=len)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    scored = quality.score(numbered, table(spark, sf_dir, "labels"), row=row)
    accepted = scored.where("predicted = 1").select(row)
    return numbered.join(accepted, row, "left_semi").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share, however short; every document stays, and so does every column."""
    told = "removed_lines"
    aside = told + "_" + max(docs.columns, key=len)
    cleaned = line_dedup.remove_boilerplate(docs.withColumnRenamed(told, aside))
    return cleaned.drop(told).withColumnRenamed(aside, told).select(*docs.columns)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; a row with a null id is a group of its own."""
    found = simhash.near_duplicates(docs, width=3, distance=2)
    kept = found.where("doc_id = component_id").select("doc_id")
    own = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(own)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return sum_squares.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_deduplication", line_deduplication),
          ("simhash_near_duplicates", simhash_near_duplicates), ("packing", packing)]

#: No SQL can state the classifier or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
