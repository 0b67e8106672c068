"""The registered query of every operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit, byte_bpe, conversations, embedding_dedup, hard_negatives, language, line_dedup, pivot_search, quality,
               simhash, suffix_tree, sum_squares, token_counts)
from .tables import table


def _whole_numbers(vectors: DataFrame, *more: str) -> DataFrame:
    """(vec_id, vector): each component times 256, rounded down; vectors that hold null or non-finite components are left out."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(finite).select("vec_id", scaled.alias("vector"), *more)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _whole_numbers(table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(whole, F.col("vec_id") % 50 == 0, k=5).select(
        "query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sum_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_squares.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), *files, offsets=False, packed=True)
    decoded = byte_bpe.decode(encoded, *files, with_text=False)
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_summary(damaged, F.col("present"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _whole_numbers(table(spark, sf_dir, "embeddings"), "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(whole.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, k=10, low=30, high=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_pivot_search, op3_token_matrices, op4_token_counts, op5_quality, op6_sum_squares,
    op7_line_dedup, op8_suffix_tree, op9_simhash, op10_byte_bpe, op11_language, op12_conversation_repair, op13_hard_negatives, pipeline)}

ORACLE_SQL = {"op1_embedding_dedup": embedding_dedup.SQL, "op2_pivot_search": pivot_search.SQL,
              "op7_line_dedup": line_dedup.SQL, "op13_hard_negatives": hard_negatives.SQL}
