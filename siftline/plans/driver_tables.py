"""Posting-shaped inputs derived from the driver's tables.

The prose of the driver tables holds none of the vocabulary. Titles, places, company names and dates are
therefore made of the tables' own values (sentences, names, segments, nations, order dates) with words of the
vocabulary between them; in postings, every row of the documents carries one value of each list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import literal_array

AS_OF = "2026-09-24"

# value lists, cycled by doc_id; lengths are pairwise coprime so the combinations mix
TITLES = ("Senior Kitchen Gardener", "Tree Feller", "Irrigation Fitter / Market Gardener", "Botany Writer", "Rose Gardener (Berlin)",
          "Pilot", "Orchard Keeper & Gardener", "שותל/ית בוטני", "Palm Gardening", "Landscape Surveyor", "Head of Botany", "Butcher",
          "Soil Sampler")
COMPANIES = ("Acme Ltd", "ACME", "Northbank", "Zed Insurance", "Hidden", "Blue Cloud Inc", "Orchard Foods",
             "Orchard Foods Group", "Medline Hospital", "Radio Nine", "Quiet Co")
LOCATIONS = ("Tel Aviv", "Tel Aviv, Israel", "Haifa", "Jerusalem / Tel Aviv", "Berlin, Germany", "London, GB",
             "Remote", "", "North", "רמת גן", "Austin, TX", "Tel Aviv or Rehovot", "Springfield", "Remote (France)",
             "Israel", "Beer Sheva", "Ness Ziona")
TAILS = ("Pruning and hedges, seedlings, harvests, perennials.", "Budget pruning only.",
         "We keep your personal file as an applicant with the pruning plans.",
         "Compost, mulching, blossom, soil, herbs and hedges.",
         "Lay asphalt with concrete, scaffolds, a crane, diesel and pruning.", "-",
         "3+ years with a drip irrigation system.")
POSTED = ("2026-09-20", "2026-09-04", "2026-09-03", "20/09/2026", "1.9.26", "2026-09-20T23:30:00Z", "1790000000000",
          "Sep 17, 2026", "17th September 2026", "Today", "yesterday", "3 days ago", "2 weeks ago", "30+ days ago",
          "a month ago", "לפני שבועיים", "5 ימים", "", "2026-02-30")
UPDATED = ("", "2026-09-22", "", "2026-08-01", "2027-01-01")
URL_SUFFIXES = ("/", "?utm_source=feed", "?b=2&a=1&ref=x", "#top")
LOW_PRIORITY_SOURCE = "src19"
LEGAL_FORMS = (" Ltd", " Group", "", ", Inc.", " בע\"מ")
BETWEEN_PLACES = (" | ", "; ", " / ", " or ", ", ")
# the last order dates end up shortly after AS_OF
DAYS_MOVED = 10_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that is smaller than one split per core, by the planner's estimate of its bytes.

    Rule evaluation is bound by CPU, and a small file with one row group would run in one task.
    A larger table comes in enough splits and isn't shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * split else df


def cycle(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(literal_array(values), (by % len(values) + 1).cast("int"))


def block(key: Column, size: int) -> Column:
    """Number of the run of ``size`` neighbouring keys, as text."""
    return F.floor(key / size).cast("string")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per document: the whole text plus a tail that carries the vocabulary."""
    return postings_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id"))


def postings_of(doc: DataFrame) -> DataFrame:
    key = F.col("doc_id")
    tail = cycle(TAILS, key)
    return doc.select(
        cycle(TITLES, key).alias("title"),
        # a third of the rows share few company names, the others get more names as the table grows
        F.when(key % 3 == 0, cycle(COMPANIES, key)).otherwise(
            F.concat_ws(" ", cycle(COMPANIES, key), block(key, 500))).alias("company"), "source",
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/job/"), block(key, 40),
                 cycle(URL_SUFFIXES, key)).alias("url"),
        # a teaser instead of a text where the tail is '-'
        F.when(tail == "-", F.concat(F.lit("Teaser in "), F.col("lang"))).otherwise(
            F.concat_ws(" ", "text", tail)).alias("description"),
        cycle(LOCATIONS, key).alias("location"), cycle(POSTED, key).alias("posted_raw"),
        cycle(UPDATED, key).alias("updated_raw"), key.cast("string").alias("job_id"),
        F.lit("").alias("experience_hint"), F.lit(False).alias("home_context"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("listing_url"),
        F.lit("").alias("industry"), key.alias("ord"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, title): every sentence of every document as a title; a third starts with a title of the list."""
    doc = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    parts = doc.select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("pos", "sentence"))
    turn = F.col("doc_id") + F.col("pos")
    return parts.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.when(turn % 3 == 0, F.concat(
        cycle(TITLES, turn), F.lit(" "), "sentence")).otherwise(F.col("sentence")).alias("title"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, company): part and brand names with a legal form by the size."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.concat("p_name", F.lit(" & "), "p_brand", cycle(LEGAL_FORMS, F.col("p_size")))
                       .alias("company"))


def places_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, c_name, c_nationkey, c_mktsegment, location): a place by the nation, alone or with the nation's
    and the customer's name."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    place, between = cycle(LOCATIONS, F.col("c_nationkey")), cycle(BETWEEN_PLACES, F.col("c_custkey"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.when(F.col("c_mktsegment") == "HOUSEHOLD", place).otherwise(
            F.concat(place, between, "n_name", F.lit(" | "), "c_name")).alias("location"))


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, posted_raw, updated_raw): order dates, moved into the years before the run, in every form."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), "o_orderkey")
    day = F.date_add(F.col("o_orderdate").cast("date"), DAYS_MOVED)
    age = F.datediff(as_of(), day)
    form = F.col("o_custkey") % 12

    def shown(pattern: str) -> Column:
        return F.date_format(day, pattern)

    def ago(count: Column, unit: str) -> Column:
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(unit))).otherwise("Today")

    posted = (
        F.when(form == 0, shown("yyyy-MM-dd")).when(form == 1, shown("dd/MM/yyyy")).when(form == 2, shown("d.M.yy"))
        .when(form == 3, F.concat(shown("yyyy-MM-dd"), F.lit("T23:30:00Z")))
        .when(form == 4, (F.unix_date(day).cast("bigint") * 86_400_000 + 82_800_000).cast("string"))
        .when(form == 5, shown("MMM d, yyyy")).when(form == 6, shown("d MMMM yyyy"))
        .when(form == 7, ago(age, " days ago")).when(form == 8, ago(F.floor(age / 7), "+ weeks ago"))
        .when(form == 9, ago(age, " ימים")).when(form == 10, cycle(POSTED, F.col("o_orderkey"))).otherwise(""))
    updated = F.when(F.col("o_orderstatus") == "O", F.date_format(
        F.date_add(day, (F.col("o_custkey") % 40).cast("int")), "yyyy-MM-dd"))
    return o.select("o_orderkey", posted.alias("posted_raw"), updated.alias("updated_raw"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def rules():
    from ..vocab import starter_rules

    return starter_rules().with_(low_priority_sources=(LOW_PRIORITY_SOURCE,))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cascade import evaluate

    return evaluate(postings(spark, sf_dir), as_of(), rules())


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative table as an earlier run left it: the documents that carry a label, one row per address."""
    from .. import labels as L
    from ..functions import companies, dates, places, urls
    from ..operators.firsts import first_per_key
    from ..schemas import POSTINGS_CURRENT, conform

    key, r = F.col("ord"), rules()
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")).distinct()
    base = postings(spark, sf_dir).drop("description").join(labelled, "ord", "left_semi")
    place = F.when(key % 4 == 0, L.UNKNOWN_PLACE).otherwise(F.col("location"))
    date = F.when(key % 6 != 0, F.date_add(F.lit("2026-08-28").cast("date"), (key % 25).cast("int")))
    rows = base.select(
        "title", "company", "source", place.alias("location"),
        F.when(key % 3 == 0, "").otherwise("2 years").alias("experience"), F.lit("stored").alias("reason"), "url",
        dates.date_display(date).alias("date_display"), date.alias("date_iso"),
        urls.canonical_url(F.col("url")).alias("key"),
        F.concat_ws("|", companies.company_title_key(F.col("company"), F.col("title"), r),
                    places.location_key(place, r)).alias("alt_key"),
        F.date_add(F.lit("2026-09-01").cast("date"), (key % 5).cast("int")).alias("first_seen"),
        F.lit("2026-09-10").cast("date").alias("last_seen"),
        F.when(key % 2 == 0, "").otherwise(L.MEDIA).alias("company_type"), key.alias("ord"))
    return conform(first_per_key(rows, ["key"]), POSTINGS_CURRENT)


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row per source of the documents and one per order, cycling the four outcomes."""
    from .. import labels as L

    sources = table(spark, sf_dir, "documents").select("source").distinct()
    links = sources.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("url"), F.col("source").alias("site"),
        F.lit("list").alias("method"), F.lit(L.OK).alias("status"), F.lit("").alias("error"),
        F.lit(0).cast("bigint").alias("count"), (-F.substring("source", 4, 9).cast("bigint") - 1).alias("ord"))
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://o.example.com/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_custkey") % 9 == 0, F.concat(F.lit("Bing "), "o_orderpriority"))
        .when(F.col("o_custkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("site"),
        F.lit("search").alias("method"),
        F.when(F.col("o_orderstatus") == "O", L.OK).when(F.col("o_orderstatus") == "F", L.FAILED)
        .when(F.col("o_custkey") % 3 == 0, L.UNREACHABLE).otherwise(L.PARTIAL).alias("status"),
        F.when(F.col("o_orderstatus") == "P", L.NOT_SCANNED).otherwise("").alias("error"),
        F.lit(0).cast("bigint").alias("count"), F.col("o_orderkey").alias("ord"))
    return links.unionByName(orders)


#: How the postings are dealt over sources, by doc_id.
LANDED_KINDS = ("greenhouse", "workable", "linkedin", "adamtotal", "page", "lever")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, rank, source, part, slug, item, url, body): the postings as boards, lists and pages would answer."""
    p = postings(spark, sf_dir)
    key, k = F.col("ord"), F.col("ord").cast("string")
    html = _text("<p>", _escaped(F.col("description")), "</p>")
    title, place = _escaped(F.col("title")), F.col("location")
    nothing = F.lit("")

    def row(part: str, slug: Column, body: Column, item: Column = nothing, url: Column = nothing) -> Column:
        return F.struct(F.lit(part).alias("part"), slug.alias("slug"), item.alias("item"), url.alias("url"), body.alias("body"))

    def list_of(name: str, *jobs: Column) -> Column:
        return _text(f'{{"{name}":[', F.concat_ws(",", *[F.to_json(job) for job in jobs]), "]}")

    board = _text("gh-", k)
    greenhouse = (row("list", board, list_of("jobs", F.struct(
        key.alias("id"), "title", F.col("url").alias("absolute_url"), F.struct(place.alias("name")).alias("location"),
        _escaped(html).alias("content"), F.col("posted_raw").alias("first_published"), F.col("updated_raw").alias("updated_at")))),
        F.when(key % 12 == 0, row("board", board, F.to_json(F.struct(F.col("company").alias("name"))))))
    account = _text("wk-", block(key, 20))
    workable = (row("list", account, list_of("results", F.struct("title", _text("SC", k).alias("shortcode"), F.lit(False).alias("remote"), F.col(
        "posted_raw").alias("published"), F.struct(place.alias("city"), nothing.alias("country")).alias("location"))), url=_text("https://w.example.com/", k)),
        # a third of the details were not landed
        F.when(key % 3 < 2, row("detail", account, F.to_json(F.struct(html.alias("description"))), _text("SC", k))),
        F.when(key % 40 == 1, row("board", account, F.to_json(F.struct(F.col("company").alias("name"))))))
    search = _text("https://www.linkedin.com/jobs-guest/search?start=", block(key, 60))
    linkedin = (row("list", search, _text(
        '<ul><li><div data-entity-urn="urn:li:job:', k, '"><h3>', title, "</h3><h4>", F.col("company"), '</h4><span class="job-search-card__location">', place,
        '</span><time datetime="', F.col("posted_raw"), '">x</time></div><li><p>no card</p></ul>'), url=_text(search, "&p=", k)),
        row("detail", search, _text('<div class="show-more-less-html__markup">', _escaped(F.col("description")), "</div>"), k))
    firm = _text("https://career.adamtotal.co.il/c", block(key, 30))
    adamtotal = (row("list", firm, _text(
        '<div class="job-card-logo"><img alt="לוגו ', F.col("company"), ', join us"></div><article class="job-card" data-job-title="', title,
        '"><div class="job-meta"><span><i class="fa-map-marker-alt"></i>', place, '</span></div><a class="job-detail-link" href="/Jobs/', k,
        '">x</a><div class="description-text">', html, "</div></article>"), url=_text(firm, "/", k)),)
    page = (row("page", F.col("listing_url"), _text('<html><script type="application/ld+json">', F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), title.alias("title"), html.alias("description"), F.col("posted_raw").alias("datePosted"),
        F.col("updated_raw").alias("dateModified"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"),
        F.struct(place.alias("address")).alias("jobLocation"))), "</script></html>"), nothing, F.col("url")),)
    team = _text("lv-", block(key, 500))
    lever = (row("list", team, F.concat(F.lit("["), F.to_json(F.struct(F.lit("Cook").alias("text"), F.lit("https://c.example.com/").alias("hostedUrl"))), F.lit(","),
                                        F.to_json(F.struct(
        F.col("title").alias("text"), F.col("url").alias("hostedUrl"), (1790000000000 - (key % 40) * 86_400_000).alias("createdAt"), k.alias("id"),
        F.struct(place.alias("location")).alias("categories"), F.col("description").alias("descriptionPlain"))), F.lit("]")),
        url=_text("https://l.example.com/", k)),)
    parts = dict(greenhouse=greenhouse, workable=workable, linkedin=linkedin, adamtotal=adamtotal, page=page, lever=lever)
    kind = cycle(LANDED_KINDS, key)
    rows = F.coalesce(*[F.when(kind == name, F.array_compact(F.array(*own))) for name, own in parts.items()])
    return p.select(key.alias("key"), kind.alias("source"), F.posexplode(rows).alias("rank", "r")).select("key", "rank", "source", "r.*")


def landed_files(spark: SparkSession, sf_dir: str, files: int = 8) -> str:
    """A new folder in the shared one with ``landed`` in the order of the documents."""
    from ..session import scratch_path

    folder = scratch_path(spark, "landed")
    rows = landed(spark, sf_dir).repartitionByRange(files, "key", "rank").sortWithinPartitions("key", "rank")
    rows.drop("key", "rank").write.parquet(folder)
    return folder


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which some boards are known."""
    return table(spark, sf_dir, "nation").select(F.lit("lever").alias("kind"), F.concat(F.lit("LV-"), (F.col("n_nationkey") * 2).cast("string")).alias("slug"),
                                                 F.initcap("n_name").alias("company"))
