"""Landed API payloads to one posting schema.

Every flattener reads (slug, body) rows, parses the body against an explicit schema and emits
``FLAT`` columns. Postings are exploded from inside a row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import extract, text_or_empty
from ..functions.staging import stage
from ..functions.text import html_to_text, strip

FLAT = ("slug", "board_name", "title", "url", "location", "description", "posted_raw", "updated_raw", "job_id")

GREENHOUSE = """name string, jobs array<struct<title:string, absolute_url:string, location:struct<name:string>,
  content:string, first_published:string, updated_at:string, id:string>>"""
LEVER = """array<struct<text:string, hostedUrl:string, country:string, createdAt:bigint, id:string,
  categories:struct<location:string, allLocations:array<string>>, descriptionPlain:string, additionalPlain:string,
  lists:array<struct<text:string, content:string>>>>"""
ASHBY = """jobs array<struct<title:string, jobUrl:string, location:string,
  secondaryLocations:array<struct<location:string>>, address:struct<postalAddress:struct<addressCountry:string>>,
  isRemote:boolean, descriptionPlain:string, descriptionHtml:string, publishedAt:string, updatedAt:string,
  id:string>>"""
WORKABLE = """name string, results array<struct<title:string, shortcode:string, remote:boolean, published:string,
  location:struct<city:string, country:string>, locations:array<struct<city:string, country:string>>>>"""
WORKABLE_DETAIL = "description string, requirements string, benefits string"
SMARTRECRUITERS = """content array<struct<id:string, name:string, releasedDate:string,
  company:struct<name:string>, location:struct<city:string, country:string>>>"""
SMARTRECRUITERS_DETAIL = """jobAd struct<sections:struct<jobDescription:struct<text:string>,
  qualifications:struct<text:string>, additionalInformation:struct<text:string>>>"""
COMEET_POSITIONS = """array<struct<name:string, uid:string, company_name:string, time_updated:string,
  url_comeet_hosted_page:string, url_active_page:string,
  location:struct<name:string, city:string, country:string>, details:array<struct<name:string, value:string>>,
  custom_fields:struct<details:array<struct<name:string, value:string>>>>>"""
WORKDAY_LIST = "jobPostings array<struct<title:string, externalPath:string, postedOn:string>>"
WORKDAY_DETAIL = """jobPostingInfo struct<location:string, country:struct<descriptor:string>, externalUrl:string,
  jobDescription:string, startDate:string, jobReqId:string>"""
DRUSHIM = """ResultList array<struct<Code:string, JobInfo:struct<Link:string, Date:string, JumpDate:string>,
  JobContent:struct<Name:string, Addresses:array<struct<City:string>>, Zones:array<struct<NameInHebrew:string>>,
    Experience:struct<NameInHebrew:string>>,
  Company:struct<CompanyDisplayName:string, NameInHebrew:string>>>"""
EMBEDDED_CARDS = """metaData struct<mosaicProviderJobCardsModel:struct<results:array<struct<displayTitle:string,
  title:string, jobkey:string, company:string, formattedLocation:string, formattedRelativeTime:string>>>>"""

# Where the pages carry their data.
COMEET_POSITIONS_MARK = "COMPANY_POSITIONS_DATA ="
COMEET_COMPANY = r'COMPANY_DATA = \{"name": "([^"]+)"'
EMBEDDED_CARDS_PATTERN = (r"(?s)window\.mosaic\.providerData\[\"mosaic-provider-jobcards\"\]\s*=\s*"
                          r"(\{.*?\});")


def _or_empty(column: Column) -> Column:
    return text_or_empty(column)


def join_filled(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*[_or_empty(p) for p in parts]), lambda p: p != ""), separator)


def join_filled_array(parts: Column, separator: str) -> Column:
    return text_or_empty(F.array_join(F.filter(parts, lambda p: _or_empty(p) != ""), separator))


def _strip_commas(text: Column) -> Column:
    return F.regexp_replace(text, r"^[, ]+|[, ]+$", "")


def carried(df: DataFrame) -> list[str]:
    """Where a row of a landed file was read (``_at``) and its place in the payload, if the input says so."""
    return [name for name in ("_at", "_pos") if name in df.columns and "_at" in df.columns]


def _flat(df: DataFrame, *more: str, **columns: Column) -> DataFrame:
    filled = {name: columns.get(name, F.lit("")) for name in FLAT if name != "slug"}
    return df.select("slug", *[_or_empty(column).alias(name) for name, column in filled.items()], *more, *carried(df))


def _each(payloads: DataFrame, array: Column | str) -> DataFrame:
    """One row per item ``j`` of an array, with its place."""
    return payloads.select("*", F.posexplode(array).alias("_pos", "j"))


def _jobs(payloads: DataFrame, schema: str, array: str) -> DataFrame:
    return _each(payloads.withColumn("p", F.from_json("body", schema)), array)


def flatten_greenhouse(payloads: DataFrame) -> DataFrame:
    return _flat(_jobs(payloads, GREENHOUSE, "p.jobs"), board_name=F.coalesce(F.nullif("p.name", F.lit("")), "slug"),
                 title=F.col("j.title"), url=F.col("j.absolute_url"), location=F.col("j.location.name"),
                 description=html_to_text(F.col("j.content")), posted_raw=F.col("j.first_published"),
                 updated_raw=F.col("j.updated_at"), job_id=F.col("j.id"))


def flatten_lever(payloads: DataFrame, home_code: str = "IL", home_name: str = "Israel") -> DataFrame:
    """All locations, plus the country when the code is home and the text does not say so. Epoch date."""
    all_locations = F.when(F.size("j.categories.allLocations") > 0, F.col("j.categories.allLocations")).otherwise(
        F.array("j.categories.location"))
    place = join_filled_array(all_locations, " | ")
    named = F.when((F.col("j.country") == home_code) & ~F.contains(F.lower(place), F.lit(home_name.lower())),
                   _strip_commas(F.concat(place, F.lit(f", {home_name}")))).otherwise(place)
    sections = F.flatten(F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")),
                                     lambda s: F.array(s["text"], html_to_text(s["content"]))))
    description = join_filled_array(F.concat(F.array("j.descriptionPlain"), sections, F.array("j.additionalPlain")), "\n")
    # an object instead of a list is an error answer, not a posting
    answers = payloads.where(F.ltrim("body").startswith("["))
    jobs = _each(answers, F.from_json("body", LEVER))
    return _flat(jobs, board_name=F.col("slug"), title=F.col("j.text"), url=F.col("j.hostedUrl"), location=named,
                 description=description, posted_raw=F.col("j.createdAt").cast("string"), job_id=F.col("j.id"))


def flatten_ashby(payloads: DataFrame) -> DataFrame:
    """Main and further locations, the country when missing, and a remote mark."""
    places = F.concat(F.array("j.location"), F.coalesce(
        F.transform("j.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>")))
    place = join_filled_array(places, " | ")
    country = _or_empty(F.col("j.address.postalAddress.addressCountry"))
    with_country = F.when((country != "") & ~F.contains(F.lower(place), F.lower(country)),
                          _strip_commas(F.concat(place, F.lit(", "), country))).otherwise(place)
    remote = F.when(F.col("j.isRemote") & ~F.contains(F.lower(with_country), F.lit("remote")),
                    strip(F.concat(with_country, F.lit(" (Remote)")))).otherwise(with_country)
    plain = F.nullif("j.descriptionPlain", F.lit(""))
    return _flat(_jobs(payloads, ASHBY, "p.jobs"), board_name=F.col("slug"), title=F.col("j.title"),
                 url=F.col("j.jobUrl"), location=remote,
                 description=F.coalesce(plain, html_to_text(F.col("j.descriptionHtml"))),
                 posted_raw=F.col("j.publishedAt"), updated_raw=F.col("j.updatedAt"), job_id=F.col("j.id"))


def flatten_workable(payloads: DataFrame) -> DataFrame:
    """List rows; the text comes from a second payload (``detail_join`` on slug and job_id)."""
    locations = F.when(F.size("j.locations") > 0, F.col("j.locations")).otherwise(F.array("j.location"))
    place = F.array_join(F.transform(locations, lambda l: join_filled(", ", l["city"], l["country"])), " | ")
    remote = F.when(F.col("j.remote"), strip(F.concat(place, F.lit(" (Remote)")))).otherwise(place)
    return _flat(_jobs(payloads, WORKABLE, "p.results"), board_name=F.coalesce(F.nullif("p.name", F.lit("")), "slug"),
                 title=F.col("j.title"),
                 url=F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), "j.shortcode", F.lit("/")),
                 location=remote, posted_raw=F.col("j.published"), job_id=F.col("j.shortcode"))


def workable_details(payloads: DataFrame) -> DataFrame:
    """(slug, job_id, description) of detail payloads."""
    p = payloads.withColumn("p", F.from_json("body", WORKABLE_DETAIL))
    filled = F.filter(F.array("p.description", "p.requirements", "p.benefits"), lambda s: _or_empty(s) != "")
    return p.select("slug", "job_id", F.array_join(F.transform(filled, html_to_text), "\n").alias("description"))


def flatten_smartrecruiters(payloads: DataFrame, home_code: str = "il", home_name: str = "Israel") -> DataFrame:
    """List rows; the board's name is the last one given in the payload."""
    country = F.when(F.col("j.location.country") == home_code, home_name).otherwise(F.col("j.location.country"))
    names = F.filter(F.transform("p.content", lambda j: j["company"]["name"]), lambda n: _or_empty(n) != "")
    return _flat(_jobs(payloads, SMARTRECRUITERS, "p.content"),
                 board_name=F.coalesce(F.try_element_at(names, F.lit(-1)), "slug"), title=F.col("j.name"),
                 url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "slug", F.lit("/"), "j.id"),
                 location=join_filled(", ", F.col("j.location.city"), country), posted_raw=F.col("j.releasedDate"),
                 job_id=F.col("j.id"))


def smartrecruiters_details(payloads: DataFrame) -> DataFrame:
    """(slug, job_id, description): three sections; the one about the company is left out."""
    p = payloads.withColumn("p", F.from_json("body", SMARTRECRUITERS_DETAIL))
    sections = [html_to_text(F.col(f"p.jobAd.sections.{name}.text"))
                for name in ("jobDescription", "qualifications", "additionalInformation")]
    return p.select("slug", "job_id", F.concat_ws("\n", *sections).alias("description"))


def comeet_positions(pages: DataFrame) -> DataFrame:
    """(slug, board_name, body) of company pages: the position list embedded after its marker."""
    tail = F.substring_index("html", COMEET_POSITIONS_MARK, -1)
    found = pages.where(F.contains("html", F.lit(COMEET_POSITIONS_MARK)))
    # the JSON reader takes the first value and leaves the rest of the script alone
    return found.select("slug", _or_empty(extract(F.col("html"), COMEET_COMPANY)).alias("board_name"),
                        strip(tail).alias("body"), *carried(pages))


def flatten_comeet(payloads: DataFrame, home_code: str = "IL", home_name: str = "Israel") -> DataFrame:
    """Positions of a company page or the API; the company of a position wins over the board's."""
    answers = payloads.where(F.ltrim("body").startswith("["))
    jobs = _jobs(answers, COMEET_POSITIONS, "p")
    country = F.when(F.col("j.location.country") == home_code, home_name).otherwise(F.col("j.location.country"))
    place = F.coalesce(F.nullif(join_filled(", ", F.col("j.location.city"), country), F.lit("")), "j.location.name")
    details = F.when(F.size("j.details") > 0, F.col("j.details")).otherwise(F.col("j.custom_fields.details"))
    names = F.filter(F.transform("p", lambda j: j["company_name"]), lambda n: _or_empty(n) != "")
    board = F.nullif("board_name", F.lit("")) if "board_name" in payloads.columns else F.try_element_at(names, F.lit(1))
    url = F.coalesce(F.nullif("j.url_comeet_hosted_page", F.lit("")), "j.url_active_page")
    return _flat(jobs, board_name=F.coalesce(F.nullif("j.company_name", F.lit("")), board, "slug"),
                 title=F.col("j.name"), url=url, location=place,
                 description=F.array_join(F.transform(details, lambda d: html_to_text(d["value"])), "\n"),
                 updated_raw=F.col("j.time_updated"), job_id=F.col("j.uid")).where("url <> ''")


def flatten_workday(lists: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """List rows with their detail payload by (slug, path); see ``detail_join`` for the missing ones.

    ``slug`` is the site root of the board. Returns (postings, missing details per slug).
    """
    rows = _jobs(lists, WORKDAY_LIST, "p.jobPostings")
    rows = rows.select("slug", F.col("j.title").alias("title"), F.col("j.externalPath").alias("path"),
                       F.col("j.postedOn").alias("posted_on"), *carried(rows)).where(_or_empty(F.col("path")) != "")
    info = details.withColumn("p", F.from_json("body", WORKDAY_DETAIL)).select(
        "slug", "path", F.col("p.jobPostingInfo").alias("info"))
    found, missing = detail_join(rows, info, ["slug", "path"])
    flat = _flat(found, title=F.col("title"),
                 url=F.coalesce(F.nullif("info.externalUrl", F.lit("")), F.concat("slug", "path")),
                 location=join_filled(", ", F.col("info.location"), F.col("info.country.descriptor")),
                 description=html_to_text(F.col("info.jobDescription")),
                 posted_raw=F.coalesce(F.nullif("info.startDate", F.lit("")), "posted_on"),
                 job_id=F.col("info.jobReqId"))
    return flat, missing


def flatten_drushim(payloads: DataFrame, site: str = "https://www.drushim.co.il") -> DataFrame:
    """Distinct cities in order, else zones; a structured experience; publishing and renewal date."""
    content = "j.JobContent"
    cities = F.array_distinct(F.filter(F.transform(f"{content}.Addresses", lambda a: a["City"]),
                                       lambda c: _or_empty(c) != ""))
    zones = F.filter(F.transform(f"{content}.Zones", lambda z: z["NameInHebrew"]), lambda z: _or_empty(z) != "")
    link = F.col("j.JobInfo.Link")
    url = F.when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(
        F.concat(F.lit(f"{site}/"), link))
    jobs = _jobs(payloads, DRUSHIM, "p.ResultList").where(_or_empty(link) != "")
    company = F.coalesce(F.nullif("j.Company.CompanyDisplayName", F.lit("")), "j.Company.NameInHebrew")
    flat = jobs.withColumn("experience_hint", _or_empty(F.col(f"{content}.Experience.NameInHebrew")))
    columns = dict(board_name=company, title=F.col(f"{content}.Name"), url=url,
                   location=F.coalesce(F.nullif(F.array_join(cities, ", "), F.lit("")), F.array_join(zones, " / ")),
                   posted_raw=F.col("j.JobInfo.Date"), updated_raw=F.col("j.JobInfo.JumpDate"), job_id=F.col("j.Code"))
    return _flat(flat, "experience_hint", **columns)


def flatten_embedded_cards(pages: DataFrame, job_url: str = "https://il.indeed.com/viewjob?jk=") -> DataFrame:
    """Job cards a page stores as a script assignment."""
    body = F.regexp_extract("html", EMBEDDED_CARDS_PATTERN, 1)
    results = F.from_json(body, EMBEDDED_CARDS)["metaData"]["mosaicProviderJobCardsModel"]["results"]
    cards = _each(pages, results).where(_or_empty(F.col("j.jobkey")) != "")
    return _flat(cards, board_name=F.col("j.company"),
                 title=F.coalesce(F.nullif("j.displayTitle", F.lit("")), "j.title"),
                 url=F.concat(F.lit(job_url), "j.jobkey"), location=F.col("j.formattedLocation"),
                 posted_raw=F.col("j.formattedRelativeTime"), job_id=F.col("j.jobkey"))


def board_names(payloads: DataFrame, *more: str) -> DataFrame:
    """(slug, name), and the columns ``more``, of the payloads that describe a board itself: its largest name; boards without one are left out."""
    named = payloads.select(*more, "slug", strip(_or_empty(F.get_json_object("body", "$.name"))).alias("name")).where("name <> ''")
    return named.groupBy(*more, "slug").agg(F.max("name").alias("name"))


def named_boards(flat: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Postings with the name that the second payload of their board gives; it wins over the one in the list."""
    joined = flat.join(names.select(*(keys or ["slug"]), F.col("name").alias("_name")), keys or ["slug"], "left")
    return joined.withColumn("board_name", F.coalesce("_name", "board_name")).select(flat.columns)


#: List rows of so many bytes, by the planner's estimate, are joined in twice as many pieces as the session's shuffles have.
LARGE = 16 << 20


def detail_join(rows: DataFrame, details: DataFrame, keys: list[str], fetched: str | None = None,
                count_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """List rows with their detail, and per slug (the first key, or ``count_by``) the number of list rows whose detail is missing.

    Details are reduced to one per key before the join, so a key that was fetched many times adds no rows: the one
    with the largest value of the column ``fetched`` (which isn't returned), else the smallest detail.

    Pieces of a shuffle that are small as compressed bytes are put together, and millions of narrow rows that compress well
    would be sorted in one task. A stated number of pieces stays as it is, if it isn't the one that the grouping gave.
    """
    payload = [c for c in details.columns if c not in (*keys, fetched)]
    detail = F.struct(*payload)
    chosen = F.min(detail) if fetched is None else F.max(F.struct(fetched, detail.alias("d")))["d"]
    one = details.groupBy(*keys).agg(chosen.alias("_d"))
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= LARGE:
        one = one.repartition(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    joined = rows.join(one, keys, "left")
    found = joined.where("_d is not null").select(*rows.columns, "_d.*")
    missing = joined.where("_d is null").groupBy(count_by or keys[0]).agg(F.count("*").alias("missing"))
    return found, missing


def predetail_prune(rows: DataFrame, rules, keep_foreign: bool | Column = False) -> DataFrame:
    """Rows worth a detail read: a potential title, an address, and no clearly foreign place (unless ``keep_foreign`` holds)."""
    from ..functions.places import FOREIGN, classify_location
    from ..functions.titles import is_potential, title_class

    # staged, as a filter would be repeated in every branch of a union below
    keep = F.lit(keep_foreign) if isinstance(keep_foreign, bool) else keep_foreign
    step = stage(rows, _open=(_or_empty(F.col("url")) != "") & is_potential(title_class(F.col("title"), rules))).where("_open")
    place = classify_location(F.col("location"), F.lit(""), F.lit(""), F.lit(False), rules)
    return stage(step, _near=F.when(keep, True).otherwise(place["decision"] != FOREIGN)).where("_near").select(rows.columns)
