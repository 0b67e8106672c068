"""Table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTINGS_RAW = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "title", "company", "source", "url", "description", "location", "posted_raw",
        "updated_raw", "job_id", "experience_hint")]
    + [T.StructField("home_context", T.BooleanType())]
    + [T.StructField(name, T.StringType()) for name in ("listing_url", "industry")]
    + [T.StructField("ord", T.LongType())]
)

POSTINGS_CURRENT = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "title", "company", "source", "location", "experience", "reason", "url", "date_display")]
    + [T.StructField("date_iso", T.DateType())]
    + [T.StructField("key", T.StringType()), T.StructField("alt_key", T.StringType())]
    + [T.StructField("first_seen", T.DateType()), T.StructField("last_seen", T.DateType())]
    + [T.StructField("company_type", T.StringType()), T.StructField("ord", T.LongType())]
)

RETRACTIONS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("alt_key", T.StringType()),
    T.StructField("seen_date", T.DateType()),
])

SOURCE_STATUS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("url", "site", "method", "status", "error")]
    + [T.StructField("count", T.LongType()), T.StructField("notes", T.ArrayType(T.StringType()))]
)

BOARDS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("kind", "slug", "company", "via")]
    + [T.StructField("found_on", T.DateType())]
)

VOCAB = T.StructType([
    T.StructField("list", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("is_regex", T.BooleanType()),
    T.StructField("priority", T.IntegerType()),
])

_DEFAULTS = {T.StringType: "", T.BooleanType: False, T.LongType: 0}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the columns of ``schema``: unknown ones go, missing ones take their default.

    Text is '' when missing, flags are false, dates stay null.
    """
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        default = F.lit(_DEFAULTS.get(type(field.dataType))).cast(field.dataType)
        if field.name not in have:
            return default.alias(field.name)
        return F.coalesce(F.col(field.name).cast(field.dataType), default).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])
