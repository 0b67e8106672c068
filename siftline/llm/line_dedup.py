"""Removal of lines that appear on many sites, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Standard errors around the threshold within which an estimate isn't trusted.
DOUBT = 4.0


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _document(doc_id: str, text: str) -> Column:
    """What tells documents apart: the id, then the text, so that a repeated row behaves like its twin."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def site_spread(docs: DataFrame, site: str, min_words: int, lg_k: int, threshold: int, doc_id: str,
                text: str) -> DataFrame:
    """(line, first): hash of every line on at least ``threshold`` sites and the first document that has it.

    A HyperLogLog sketch of the sites per line is merged by the aggregation. Estimates within ``DOUBT`` standard errors
    of the threshold are decided by an exact distinct count; those further away are decided by the estimate.
    """
    words = r"^\s*(\S+\s+){%d}\S" % (min_words - 1)
    lines = docs.select(_document(doc_id, text).alias("doc"), F.col(site).cast("string").alias("site"),
                        F.explode(_lines(text)).alias("line"))
    lines = lines.where(F.col("line").rlike(words)).select("doc", "site", F.xxhash64("line").alias("line"))
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.min("doc").alias("first"))
    spread = written(sketches.select("line", "first", F.hll_sketch_estimate("sites").alias("n")), "spread")
    doubt = DOUBT * 1.04 / 2 ** (lg_k / 2)
    low, high = threshold * (1 - doubt), threshold * (1 + doubt)
    sure = spread.where(F.col("n") > high).select("line", "first")
    near = spread.where((F.col("n") >= low) & (F.col("n") <= high)).select("line", "first")
    exact = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = exact.groupBy("line").agg(F.count("site").alias("n")).where(F.col("n") >= threshold)
    return sure.unionByName(near.join(exact.select("line"), "line", "left_semi"))


def remove_boilerplate(docs: DataFrame, site: str = "source", threshold: int = 8, min_words: int = 1, lg_k: int = 10,
                       doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that appear on ``threshold`` or more distinct sites, and ``removed_lines``.

    A line is what lies between line feeds, compared exactly; a blank one, or one of under ``min_words`` words, is never removed. The
    first document with such a line (the smallest id; of one id the smallest text hash) keeps it, so that copies of
    a document don't vanish altogether. A null site counts as no site; a null text stays null, an empty one empty. A
    document of nothing but such lines becomes empty and stays. Rows with a null id come first and are told apart by
    their texts. ``length``, if the table has it, is made to match the text. A column ``removed_lines`` of ``docs`` gives way.
    """
    docs = docs.drop("removed_lines")
    spread = written(site_spread(docs, site, min_words, lg_k, threshold, doc_id, text), "boilerplate")
    own = docs.select(_document(doc_id, text).alias("doc"), F.explode(F.transform(_lines(text), lambda line: F.xxhash64(line))).alias("line"))
    hits = own.join(spread, "line").where(~F.col("doc").eqNullSafe(F.col("first")))
    gone = hits.groupBy("doc").agg(F.collect_set("line").alias("gone")).select(
        F.xxhash64("doc.id", "doc.text").alias("key"), F.col("doc").alias("of"), "gone")
    rows = docs.select(F.struct("*").alias("row"), _document(doc_id, text).alias("doc"))
    rows = rows.select("row", "doc", F.xxhash64("doc.id", "doc.text").alias("key"))
    # joined by one long; the documents themselves are compared as well
    both = rows.join(gone, (rows["key"] == gone["key"]) & F.col("doc").eqNullSafe(F.col("of")), "left")
    kept = F.filter(_lines("row." + text), lambda line: ~F.array_contains("gone", F.xxhash64(line)))
    both = both.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row." + text)).otherwise(
        F.array_join(kept, "\n")).alias("new"), F.size(kept).alias("left"))
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == text:
            value = F.col("new")
        elif name == length:
            value = F.when(F.col("gone").isNull(), value).otherwise(F.length("new").cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size(_lines("row." + text)) - F.col("left"))
    return both.select(*columns, removed.cast("long").alias("removed_lines"))


#: The same for whole tables in DuckDB: exact distinct counts in place of sketches.
SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), spread AS (
  SELECT line, min(doc_id) AS first FROM lines
  WHERE regexp_matches(line, '\S') GROUP BY line HAVING count(DISTINCT source) >= 8
), pieces AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         string_split(coalesce(d.text, ''), chr(10)) AS parts,
         list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: NOT list_contains(coalesce(g.gone, []), x)) AS kept
  FROM documents d LEFT JOIN (
    SELECT doc_id, list(DISTINCT line) AS gone FROM lines JOIN spread USING (line) WHERE doc_id <> first GROUP BY doc_id
  ) g USING (doc_id)
)
SELECT doc_id, CASE WHEN len(parts) = len(kept) THEN text ELSE array_to_string(kept, chr(10)) END AS text, lang, source,
       CASE WHEN len(parts) = len(kept) THEN n_chars ELSE length(array_to_string(kept, chr(10))) END AS n_chars,
       len(parts) - len(kept) AS removed_lines
FROM pieces
"""
