"""Finding new boards: slugs of seen companies, what to probe next, which boards are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug_candidates
from ..sources.boards import KINDS, OTHER_KINDS
from .firsts import first_per_key

RECHECK_DAYS = 30


def company_slugs(companies: DataFrame) -> DataFrame:
    """(company, site, ord, rank, slug): candidate slugs of every company, the likeliest at rank 0."""
    return companies.select("company", "site", "ord", F.posexplode(slug_candidates(F.col("company"))).alias("rank", "slug"))


def probe_plan(slugs: DataFrame, probed: DataFrame, as_of: Column, recheck_days: int = RECHECK_DAYS) -> DataFrame:
    """Slugs not probed within the recheck interval."""
    recent = probed.where(F.col("probed_on") >= F.date_sub(as_of, recheck_days)).select("slug")
    return slugs.join(recent, "slug", "left_anti")


def probe_kinds(plan: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every planned slug once per kind of board."""
    return plan.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def probe_rank_cap(plan: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` probes: the likeliest slug of every company, then the alternatives."""
    return plan.orderBy("rank", "ord").limit(limit)


def probe_leftover(planned: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned slugs that were not completed."""
    return planned.select("slug").distinct().join(completed.select("slug"), "slug", "left_anti")


def probe_cache(probed: DataFrame, completed: DataFrame, as_of: Column) -> DataFrame:
    """(slug, probed_on) with the slugs that this run completed; the last date of a slug counts."""
    now = completed.select("slug", as_of.alias("probed_on"))
    return probed.select("slug", "probed_on").unionByName(now).groupBy("slug").agg(F.max("probed_on").alias("probed_on"))


def union_boards(*found: DataFrame) -> DataFrame:
    """All candidate boards (kind, slug, company, via, ord) of the finders, in the order given."""
    out: DataFrame | None = None
    for position, df in enumerate(found):
        part = df.withColumn("finder", F.lit(position))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def boards_new(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of a known kind that are not known yet; the first of equal (kind, slug) stays."""
    usable = candidates.where(F.col("kind").isin(*KINDS, *OTHER_KINDS)).withColumn("slug_low", F.lower("slug"))
    order = F.struct("finder", "ord") if "finder" in candidates.columns else F.col("ord")
    one = first_per_key(usable, ["kind", "slug_low"], order)
    have = known.select("kind", F.lower("slug").alias("slug_low"))
    return one.join(have, ["kind", "slug_low"], "left_anti").drop("slug_low")


def board_names(seeds: DataFrame, discovered: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, slug, company): seed boards before discovered ones, first per (kind, slug), seeds named by lookup."""
    titled = seeds.join(names.select("slug", F.col("company").alias("_name")), "slug", "left").select(
        "kind", "slug", F.coalesce("_name", F.lit("")).alias("company"), F.lit(0).alias("part"), "ord")
    rest = discovered.select("kind", "slug", F.coalesce("company", F.lit("")).alias("company"),
                             F.lit(1).alias("part"), "ord")
    both = titled.unionByName(rest).withColumn("slug_low", F.lower("slug"))
    return first_per_key(both, ["kind", "slug_low"], F.struct("part", "ord")).select("kind", "slug", "company")
