"""Landed files to raw postings: one order that every run finds again, one schema for all sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions.patterns import text_or_empty
from ..functions.text import company_display_name
from ..functions.urls import canonical_url, resolve_url, site_name
from ..schemas import POSTINGS_RAW
from ..session import persisted
from ..vocab import RuleSet
from . import boards, pages, payloads
from .quarantine import failed_files, sound_parquet

#: A landed row: what it belongs to, which part of it ('list', 'detail' or 'board'), its board or list, the item of a detail
#: (the job's id or path, or the text of the link to a page), the address it was read from, and what was read.
LANDED = ("source", "part", "slug", "item", "url", "body")

#: Sources in the order of a run.
PAGE = "page"
ORDER = (PAGE, "linkedin", "drushim", "jobmaster", "alljobs", "indeed", *boards.KINDS, "comeet", "workday", "adamtotal", "secret")
CARD_SOURCES = (*pages.CARD_BOARDS, "drushim", "indeed")
#: An ordinal: the place of the source, the row among all rows of the landed files, the posting among those of the row.
ROWS, POSTINGS = 1 << 37, 1 << 19

# How lists of cards are named, and the address of a posting by its id.
CARD_LABELS = {"linkedin": "LinkedIn", "jobmaster": "JobMaster", "alljobs": "AllJobs", "secret": "Secret Tel Aviv"}
CARD_URLS = {"linkedin": "https://www.linkedin.com/jobs/view/", "jobmaster": "https://www.jobmaster.co.il/jobs/checknum.asp?key=",
             "alljobs": "https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID="}


def read_landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed rows and ``_at``, the file and the row in it, which no number of partitions changes; and (file, reason) of unreadable files."""
    rows, bad = sound_parquet(spark, path, T.StructType([T.StructField(name, T.StringType()) for name in LANDED]))
    return rows.select(*LANDED, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at")), bad


def file_offsets(landed: DataFrame) -> DataFrame:
    """(file, before): the rows in all files before each, by their paths. One row per file; the files' data isn't read."""
    sizes = landed.groupBy("_at.file").agg((F.max("_at.row") + 1).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def with_ord(postings: DataFrame, offsets: DataFrame) -> DataFrame:
    """``ord`` in place of ``_source``, ``_at`` and ``_pos``: unique, and the same in every run over the same files."""
    place = F.array_position(F.array(*[F.lit(name) for name in ORDER]), F.col("_source")) - 1
    row = F.col("before") + F.col("_at.row")
    fits = (row < ROWS) & (F.col("_pos") < POSTINGS)
    number = F.when(fits, (place * ROWS + row) * POSTINGS + F.col("_pos")).otherwise(
        F.raise_error(F.lit("more rows than an ordinal can count")).cast("long"))
    joined = postings.join(offsets, F.col("_at.file") == offsets["file"])
    return joined.withColumn("ord", number).drop("_source", "_at", "_pos", "file", "before")


def read_once(landed: DataFrame) -> DataFrame:
    """Landed rows without later readings of the same list: of one address of a board, or of one company's positions whether they came
    from its page or its API. Only the repeated ones are joined, by where they stand."""
    lists = landed.where(F.col("part") == "list")
    same = F.when(F.col("source") == "comeet", boards.comeet_key(F.col("slug"))).otherwise(F.concat_ws("|", F.lower("slug"), "url"))
    seen = lists.select("source", same.alias("same"), "_at")
    first = seen.groupBy("source", "same").agg(F.min("_at").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = persisted(seen.join(first, ["source", "same"]).where("_at <> first").select(F.col("_at").alias("_again")), "again")
    return landed.join(again, landed["_at"] == again["_again"], "left_anti")


def _postings(rows: DataFrame, kind: str | Column, /, **columns: Column) -> DataFrame:
    filled = {field.name: columns.get(field.name, F.lit("").cast(field.dataType)) for field in POSTINGS_RAW if field.name != "ord"}
    filled["home_context"] = columns.get("home_context", F.lit(False))
    where = F.lit(kind) if isinstance(kind, str) else kind
    pos = F.col("_pos") if "_pos" in rows.columns else F.lit(0)
    return rows.select(*[column.alias(name) if name == "home_context" else text_or_empty(column).alias(name) for name, column in filled.items()],
                       where.alias("_source"), "_at", pos.cast("long").alias("_pos"))


#: Boards whose lists hold no texts: what reads their details, one payload a posting.
DETAILS = {"workable": payloads.workable_details, "smartrecruiters": payloads.smartrecruiters_details}


def _flat_board(landed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame | None]:
    """(kind, FLAT columns, ``_at``, ``_pos``) of one kind of board, and the missing details where they are looked up at once."""
    own = landed.where(F.col("source") == kind)
    lists = own.where(F.col("part") == "list").select("slug", "body", "_at")
    missing = None
    if kind == "comeet":
        embedded = F.col("body").contains(payloads.COMEET_POSITIONS_MARK)
        page = payloads.comeet_positions(lists.where(embedded).withColumnRenamed("body", "html"))
        api = lists.where(~embedded).withColumn("board_name", F.lit("")).select(page.columns)
        flat = payloads.flatten_comeet(page.unionByName(api))
    elif kind == "workday":
        details = own.where(F.col("part") == "detail").select("slug", F.col("item").alias("path"), "body")
        flat, missing = payloads.flatten_workday(lists, details)
        # a board of this kind has no name of its own: the first label of its host
        flat = flat.withColumn("board_name", F.initcap(F.regexp_extract("slug", boards.WORKDAY, 1)))
    else:
        flat = {"greenhouse": payloads.flatten_greenhouse, "lever": payloads.flatten_lever, "ashby": payloads.flatten_ashby,
                "workable": payloads.flatten_workable, "smartrecruiters": payloads.flatten_smartrecruiters}[kind](lists)
    return flat.withColumn("kind", F.lit(kind)), missing


def board_postings(landed: DataFrame, kinds: list[str], rules: RuleSet, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of boards, and (listing_url, missing): how many of a list's details were not landed.

    Only potential titles with an address go on, before any detail is looked up; where details are read one by one, places that are clearly abroad
    don't. A board is called by its hint (kind, slug, company), else by its own name (from its second payload, where it has one), else by its slug.
    """
    flats = [_flat_board(landed, kind) for kind in kinds]
    flat = reduce(DataFrame.unionByName, [rows for rows, _ in flats])
    names = payloads.board_names(landed.where(F.col("source").isin(*boards.KINDS) & (F.col("part") == "board")), "source")
    flat = payloads.named_boards(flat, names.withColumnRenamed("source", "kind"), ["kind", "slug"])
    one_by_one = [kind for kind in kinds if kind in DETAILS]
    flat = payloads.predetail_prune(flat, rules, keep_foreign=~F.col("kind").isin(one_by_one))
    gaps = [missing.select(F.col("slug").alias("listing_url"), "missing") for _, missing in flats if missing is not None]
    if one_by_one:
        own = landed.where(F.col("part") == "detail").select("source", "slug", F.col("item").alias("job_id"), "body")
        details = [DETAILS[kind](own.where(F.col("source") == kind)).withColumn("kind", F.lit(kind)) for kind in one_by_one]
        listed = flat.where(F.col("kind").isin(one_by_one)).drop("description").withColumn("list", boards.board_url(F.col("kind"), F.col("slug")))
        found, missing = payloads.detail_join(listed, reduce(DataFrame.unionByName, details), ["kind", "slug", "job_id"], count_by="list")
        flat = flat.where(~F.col("kind").isin(one_by_one)).unionByName(found.drop("list"))
        gaps.append(missing.select(F.col("list").alias("listing_url"), "missing"))
    hinted = hints.groupBy(F.col("kind").alias("_kind"), F.lower("slug").alias("_low")).agg(F.max("company").alias("_hint"))
    named = flat.join(hinted, (F.col("kind") == F.col("_kind")) & (F.lower("slug") == F.col("_low")), "left")
    # a position may name a company of its own, which the hint for the board doesn't change
    own_name = F.col("kind") == "comeet"
    shown = company_display_name(F.col("_hint"), F.col("board_name"), F.col("slug"))
    same = {name: F.col(name) for name in ("title", "url", "description", "location", "posted_raw", "updated_raw", "job_id")}
    found = _postings(named, F.col("kind"), company=F.when(own_name, F.col("board_name")).otherwise(shown),
                      source=F.when(own_name, F.coalesce(F.nullif("_hint", F.lit("")), "board_name")).otherwise(shown),
                      listing_url=boards.board_url(F.col("kind"), F.col("slug")), **same)
    return found, reduce(DataFrame.unionByName, gaps) if gaps else None


def _details(landed: DataFrame, as_of: Column, rules: RuleSet) -> DataFrame:
    """(source, job_id, d_title, ...): what the landed detail pages of cards say; pages without a text say nothing."""
    own = landed.where(F.col("source").isin("linkedin", "drushim", "jobmaster", "alljobs", "indeed", "secret") & (F.col("part") == "detail"))
    own = own.select("source", F.col("item").alias("job_id"), "url", F.col("body").alias("html"))
    names = ("title", "company", "description", "location", "posted", "updated", "industry")
    empty = F.lit("")
    linkedin = pages.extract_detail_page(own.where(F.col("source") == "linkedin")).withColumns({
        "company": empty, "location": empty, "posted": F.col("posted_rel"), "updated": empty})
    others = pages.posting_from_page(own.where(F.col("source") != "linkedin"), as_of, rules).withColumns({
        "posted": F.col("posted_raw"), "updated": F.col("updated_raw"), "industry": empty})
    both = linkedin.select("source", "job_id", *names).unionByName(others.select("source", "job_id", *names))
    return both.where("description <> ''").select("source", "job_id", *[F.col(name).alias(f"d_{name}") for name in names])


def card_postings(landed: DataFrame, as_of: Column, rules: RuleSet) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of lists of cards with their detail pages, the missing details of each list, and the addresses open to subscribers only.

    A card's own words go before those of its page, but for the board whose pages hold the full structured data.
    """
    own = landed.where(F.col("source").isin(*pages.CARD_BOARDS) & (F.col("part") == "list"))
    cards = pages.extract_cards(own.select("source", F.col("slug").alias("listing"), "url", F.col("body").alias("html"), "_at"),
                                pages.CARD_BOARDS, "source")
    site = reduce(lambda shown, pair: shown.when(F.col("source") == pair[0], pair[1]), CARD_LABELS.items(), F.when(F.lit(False), "")).otherwise(
        site_name(F.col("listing")))
    by_id = reduce(lambda shown, pair: shown.when(F.col("source") == pair[0], F.concat(F.lit(pair[1]), "job_id")), CARD_URLS.items(),
                   F.when(F.lit(False), "")).otherwise(resolve_url(F.col("url"), F.col("href")))
    cards = cards.select("source", "listing", "_at", F.col("pos").alias("_pos"), "job_id", "title", "company", "location", F.col("date_text").alias("posted"),
                         F.lit("").alias("updated"), "description", F.lit("").alias("hint"), "closed", site.alias("site"), by_id.alias("job_url"))
    opened, closed = pages.subscriber_only_split(cards.withColumnRenamed("job_url", "url"))
    drushim = payloads.flatten_drushim(_list_bodies(landed, "drushim"))
    indeed = payloads.flatten_embedded_cards(_list_bodies(landed, "indeed").withColumnRenamed("body", "html")).withColumn("experience_hint", F.lit(""))
    flat = [rows.select(F.lit(kind).alias("source"), F.col("slug").alias("listing"), "_at", F.col("_pos").cast("long").alias("_pos"), "job_id", "title",
                        F.col("board_name").alias("company"), "location", F.col("posted_raw").alias("posted"), F.col("updated_raw").alias("updated"),
                        F.lit("").alias("description"), F.col("experience_hint").alias("hint"), F.lit(False).alias("closed"), F.lit(label).alias("site"), "url")
            for rows, kind, label in ((drushim, "drushim", "Drushim"), (indeed, "indeed", "Indeed"))]
    opened = reduce(DataFrame.unionByName, flat, opened.select(flat[0].columns))
    opened = payloads.predetail_prune(opened, rules, keep_foreign=True)
    whole = opened.where(F.col("source") == "adamtotal")
    found, missing = payloads.detail_join(opened.where(F.col("source") != "adamtotal"), _details(landed, as_of, rules), ["source", "job_id"],
                                          count_by="listing")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(name, F.lit("")) for name in names])

    structured = F.col("source") == "alljobs"
    detailed = _postings(
        found, F.col("source"), title=F.when(structured, first("d_title", "title")).otherwise(first("title", "d_title")),
        company=F.when(structured, F.col("d_company")).otherwise(first("company", "d_company")), source=F.col("site"), url=F.col("url"),
        description=F.col("d_description"), location=first("location", "d_location"),
        posted_raw=F.when(structured, F.col("posted")).otherwise(first("posted", "d_posted")),
        updated_raw=F.when(structured, F.col("d_posted")).otherwise(first("updated", "d_updated")), job_id=F.col("job_id"),
        experience_hint=F.col("hint"), home_context=F.lit(True), listing_url=F.col("listing"), industry=F.col("d_industry"))
    plain = _postings(whole, F.col("source"), title=F.col("title"), company=first("company", "site"), source=F.col("site"), url=F.col("url"),
                      description=F.col("description"), location=F.col("location"), job_id=F.col("job_id"), home_context=F.lit(True),
                      listing_url=F.col("listing"))
    return detailed.unionByName(plain), missing.select(F.col("listing").alias("listing_url"), "missing"), closed.select("url")


def _list_bodies(landed: DataFrame, source: str) -> DataFrame:
    return landed.where((F.col("source") == source) & (F.col("part") == "list")).select("slug", "body", "_at")


def page_postings(landed: DataFrame, as_of: Column, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """Postings of pages that links lead to (``slug`` is the link, ``item`` the text under which it led to the page), and
    the number of pages without a text of each link."""
    own = landed.where(F.col("source") == PAGE).select(F.col("slug").alias("listing_url"), "url", F.col("item").alias("fallback_title"),
                                                       F.col("body").alias("html"), "_at")
    found, missing = pages.drop_without_description(pages.posting_from_page(own, as_of, rules))
    same = {name: F.col(name) for name in ("title", "company", "description", "location", "posted_raw", "updated_raw", "url", "listing_url")}
    return _postings(found, PAGE, source=site_name(F.col("listing_url")), home_context=boards.home_context(F.col("listing_url")), **same), missing


@dataclass
class Landed:
    postings: DataFrame
    statuses: DataFrame
    subscriber_urls: DataFrame


def landed_postings(landed: DataFrame, as_of: Column, rules: RuleSet, hints: DataFrame | None = None, bad: DataFrame | None = None) -> Landed:
    """All landed sources as raw postings in the order of the run, each address once, with a status row for every list.

    ``hints`` (kind, slug, company) are the names under which boards are known. A list is partial where details were missing;
    each unreadable file of ``bad`` has a failed row.
    """
    spark = landed.sparkSession
    if hints is None:
        hints = spark.createDataFrame([], "kind string, slug string, company string")
    offsets = persisted(file_offsets(landed), "files")
    there = {row[0] for row in landed.where(F.col("source").isin(*ORDER)).select("source").distinct().collect()}
    landed = read_once(landed)
    closed = spark.createDataFrame([], "url string")
    parts, gaps = [], [(spark.createDataFrame([], "listing_url string, missing long"), L.PAGES_NOT_LOADED)]
    kinds = [kind for kind in (*boards.KINDS, "comeet", "workday") if kind in there]
    if kinds:
        found, missing = board_postings(landed, kinds, rules, hints)
        parts.append(found)
        if missing is not None:
            gaps.append((missing, L.PAGES_NOT_LOADED))
    if there.intersection(CARD_SOURCES):
        found, missing, closed = card_postings(landed, as_of, rules)
        parts.append(found)
        gaps.append((missing, L.PAGES_NOT_LOADED))
    if PAGE in there or not parts:
        found, missing = page_postings(landed, as_of, rules)
        parts.append(found)
        gaps.append((missing, L.PAGE_WITHOUT_TEXT))
    postings = persisted(with_ord(reduce(DataFrame.unionByName, parts), offsets), "postings")
    lists = landed.where((F.col("part") == "list") | (F.col("source") == PAGE)).select(
        "source", F.when(F.col("source").isin(*boards.KINDS), boards.board_url(F.col("source"), F.col("slug"))).otherwise(
            F.col("slug")).alias("url")).distinct()
    gaps = [gap.withColumn("text", F.lit(text)) for gap, text in gaps]
    gap = reduce(DataFrame.unionByName, gaps).groupBy(F.col("listing_url").alias("_url")).agg(
        F.sum("missing").alias("missing"), F.min("text").alias("text"))
    joined = lists.join(gap, lists["url"] == gap["_url"], "left")
    statuses = joined.select("url", F.coalesce(site_name(F.col("url")), F.lit("")).alias("site"), F.col("source").alias("method"),
                             F.when(F.col("missing") > 0, L.PARTIAL).otherwise(L.OK).alias("status"),
                             F.when(F.col("missing") > 0, F.concat(F.col("missing").cast("string"), F.lit(" "), "text")).otherwise("").alias("error"),
                             F.lit(0).cast("long").alias("count"), F.array().cast("array<string>").alias("notes"))
    if bad is not None:
        statuses = statuses.unionByName(failed_files(bad, "landed"))
    return Landed(visited(postings), statuses, closed)


def visited(postings: DataFrame) -> DataFrame:
    """Postings whose address no earlier one has. Only the later ones are joined, by their ordinal."""
    keyed = postings.select(canonical_url(F.col("url")).alias("key"), "ord")
    first = keyed.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = persisted(keyed.join(first, "key").where("ord <> first").select(F.col("ord").alias("_again")), "visited")
    return postings.join(again, postings["ord"] == again["_again"], "left_anti")
