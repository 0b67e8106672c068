"""In-run duplicates: keep a row unless an earlier *kept* row shares one of its identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persisted
from .components import components

#: Rows of a component that are decided in one row of a grouped table; larger components take rounds over all of their rows.
ONE_BY_ONE = 2048


def _identities(jobs: DataFrame) -> DataFrame:
    """One narrow row per distinct set of identities.

    Rows with the same identities compete for one place, and only the first can win it, so a hot
    group of copies shrinks to one row per map task before anything is shuffled. Low-priority rows
    come after all others; their rank says so. Only they carry the third identity as a test.
    """
    rank = F.struct(F.col("is_low_priority").cast("int").alias("low"), F.col("ord"))
    found = jobs.groupBy("key", "alt_key", "company_title", "is_low_priority").agg(F.min(rank).alias("rank"))
    return found.select("key", "alt_key", "company_title", "is_low_priority", "rank", F.col("rank.ord").alias("ord"))


def require_unique(jobs: DataFrame, key: str) -> None:
    """An error that names a repeated or missing value of ``key``, if there is one."""
    repeated = jobs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).first()
    if repeated is not None:
        raise ValueError(f"{key} must be unique; {repeated[0]} stands on {repeated[1]} rows")


def _links(rows: DataFrame) -> DataFrame:
    """(ord, first): each row that shares an identity with others, and the first of them; as many links as rows at most for each identity.

    Company and title only matter where a low-priority row has them. A missing identity is shared with nobody.
    """
    def of(identity: str) -> DataFrame:
        groups = rows.where(F.col(identity).isNotNull()).groupBy(F.col(identity).alias("_shared")).agg(
            F.min("ord").alias("first"), F.count("*").alias("n"), F.bool_or("is_low_priority").alias("low"))
        groups = groups.where((F.col("n") > 1) & F.col("low") if identity == "company_title" else F.col("n") > 1)
        return rows.join(groups, F.col(identity) == F.col("_shared")).where("ord <> first").select("ord", "first")

    return reduce(DataFrame.unionByName, map(of, ("key", "alt_key", "company_title")))


def _in_order(rows: DataFrame) -> DataFrame:
    """``ord`` of the kept rows of each (small) component: the rule itself, row by row."""
    row = F.struct("rank", "key", "alt_key", "company_title", "is_low_priority")
    listed = rows.groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("keys"), texts.alias("alts"), texts.alias("titles"), F.array().cast("array<bigint>").alias("kept"))

    def taken(values, value):
        return F.coalesce(F.array_contains(values, value), F.lit(False))

    def decide(so_far, r):
        free = ~(taken(so_far["keys"], r["key"]) | taken(so_far["alts"], r["alt_key"]) | (r["is_low_priority"] & taken(so_far["titles"], r["company_title"])))
        return F.when(free, F.struct(
            F.array_append(so_far["keys"], r["key"]).alias("keys"), F.array_append(so_far["alts"], r["alt_key"]).alias("alts"),
            F.array_append(so_far["titles"], r["company_title"]).alias("titles"), F.array_append(so_far["kept"], r["rank"]["ord"]).alias("kept"))).otherwise(so_far)

    return listed.select(F.explode(F.aggregate("rows", start, decide, lambda done: done["kept"])).alias("ord"))


def _rounds(open_rows: DataFrame) -> list[DataFrame]:
    """The same for components of any size, one table of ``ord`` a round.

    Every round keeps the rows that come first in all their groups and drops the rows that share an
    identity with a kept one. The first row of a component is always decided, so the rounds end; their
    number is the longest chain of rows linked by alternating identities.
    """
    kept = []
    while not open_rows.isEmpty():
        # the first row of each group, found by a grouped minimum (combined on the map side);
        # a row wins when it is the first of all its groups, so the join key is unique
        winners = open_rows
        for identity in ("key", "alt_key"):
            first = open_rows.groupBy(identity).agg(F.min("rank").alias("rank")).where(F.col(identity).isNotNull()).select("rank")
            winners = winners.where(F.col(identity).isNull()).unionByName(winners.where(F.col(identity).isNotNull()).join(first, "rank", "left_semi"))
        first = open_rows.groupBy("company_title").agg(F.min("rank").alias("rank")).select("rank")
        low = F.col("is_low_priority") & F.col("company_title").isNotNull()
        winners = winners.where(~low).unionByName(winners.where(low).join(first, "rank", "left_semi"))
        winners = persisted(winners.select("ord", "key", "alt_key", "company_title"), "winners")
        kept.append(winners.select("ord"))
        left = open_rows.join(winners.select("ord"), "ord", "left_anti")
        for identity in ("key", "alt_key"):
            left = left.join(winners.select(identity), identity, "left_anti")
        # only low-priority rows are dropped by company and title; the others skip the join
        left = left.where("not is_low_priority").select(open_rows.columns).unionByName(
            left.where("is_low_priority").join(winners.select("company_title").distinct(), "company_title", "left_anti").select(open_rows.columns))
        open_rows = persisted(left, "open")
    return kept


def greedy_survivors(jobs: DataFrame, one_by_one: int = ONE_BY_ONE) -> DataFrame:
    """``ord`` of the rows the sequential rule keeps; a repeated ``ord`` is an error.

    Rows that share no identity are kept at once. The others are split into connected components, which don't touch each other: a component
    of up to ``one_by_one`` rows is decided in one grouped pass, so the number of shuffles doesn't grow with its chains; a larger one in rounds.
    """
    require_unique(jobs, "ord")
    rows = persisted(_identities(jobs), "identities")
    links = persisted(_links(rows), "shared")
    ends = links.select("ord").unionByName(links.select(F.col("first").alias("ord"))).distinct()
    linked = rows.join(ends, "ord", "left_semi")
    kept = [rows.join(ends, "ord", "left_anti").select("ord")]
    if ends.count() <= one_by_one:
        kept.append(_in_order(linked.withColumn("component", F.lit(0))))
    else:
        roots = components(links, "ord", "first")
        linked = persisted(linked.join(roots, linked["ord"] == roots["node"], "left").withColumn("component", F.coalesce("root", "ord")).drop(
            "node", "root"), "components")
        sizes = persisted(linked.groupBy("component").count(), "sizes")
        few = sizes.where(F.col("count") <= one_by_one).select("component")
        kept.append(_in_order(linked.join(few, "component", "left_semi")))
        kept += _rounds(linked.join(sizes.where(F.col("count") > one_by_one).select("component"), "component", "left_semi").drop("component"))
    return reduce(DataFrame.unionByName, kept)


def greedy_dedupe(jobs: DataFrame) -> DataFrame:
    """Rows kept by the sequential rule in (low priority, ord) order.

    ``ord`` must be unique. Columns needed: key, alt_key, company_title, is_low_priority, ord.
    """
    survivors = persisted(greedy_survivors(jobs), "survivors")
    return jobs.join(survivors, "ord", "left_semi")


def source_priority_order(postings: DataFrame, low_priority_sources: tuple[str, ...]) -> DataFrame:
    """Low-priority sources last, otherwise the given order."""
    low = F.coalesce(F.col("source").isin(*low_priority_sources), F.lit(False))
    return postings.orderBy(low, "ord")
