"""Which job board an address or a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import WORD, extract
from ..functions.places import HOME, classify_location
from ..functions.staging import stage
from ..functions.urls import authority, search_result_target
from ..vocab import RuleSet

_SLUG = rf"[{WORD}\-]+"

# Public address forms of job boards, tried in this order (kind, pattern with the slug).
BOARD_PATTERNS = (
    ("greenhouse", rf"greenhouse\.io/embed/job_board(?:/js)?\?for=({_SLUG})"),
    ("greenhouse", rf"(?:job-)?boards(?:\.eu)?\.greenhouse\.io/({_SLUG})"),
    ("greenhouse", rf"boards-api\.greenhouse\.io/v1/boards/({_SLUG})"),
    ("lever", rf"jobs\.lever\.co/([{WORD}.\-]+)"),
    ("ashby", rf"jobs\.ashbyhq\.com/([{WORD}.%\-]+)"),
    ("workable", rf"apply\.workable\.com/({_SLUG})"),
    ("smartrecruiters", rf"(?:careers|jobs)\.smartrecruiters\.com/({_SLUG})"),
)
RESERVED_SLUGS = ("embed", "api", "v1", "j", "jobs")
KINDS = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters")
OTHER_KINDS = ("comeet", "comeet_api", "workday")
BOARD_URLS = {
    "greenhouse": ("https://job-boards.greenhouse.io/", ""), "lever": ("https://jobs.lever.co/", ""),
    "ashby": ("https://jobs.ashbyhq.com/", ""), "workable": ("https://apply.workable.com/", "/"),
    "smartrecruiters": ("https://careers.smartrecruiters.com/", ""),
}
BOARD_HOSTS = r"greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com|smartrecruiters\.com"
BOARD_URL_IN_TEXT = rf"(?i)https?:(?://|\\/\\/)[{WORD}.\-]*(?:{BOARD_HOSTS})[^\s\p{{Z}}\"'<>)]*"
COMEET_PAGE = rf"(?i)comeet\.com/jobs/({_SLUG})/([0-9A-F]{{2}}\.[0-9A-F]{{3}})"
COMEET_API = (r"comeet\.co/careers-api/2\.0/company/([0-9A-F]{2}\.[0-9A-F]{3})/positions/?"
              r"\?token=([0-9A-F]{16,})")
_ASSIGN = r"[\\\"'\s\p{Z}:=]+[\"']"
COMEET_UID = rf"(?i:comeet_uid|company-uid|company_uid|companyuid|integration_id){_ASSIGN}([0-9A-F]{{2}}\.[0-9A-F]{{3}})"
COMEET_TOKEN = (rf"(?i:comeet_token|integration_token|(?<![{WORD}\-])token){_ASSIGN}"
                r"([0-9A-F]{16,})(?![0-9a-z])")
WORKDAY = rf"https?://({_SLUG})\.(wd[0-9]+)\.myworkdayjobs\.com/(?:[a-z]{{2}}-[A-Z]{{2}}/)?({_SLUG})"
WORKDAY_INTERNAL = ("wday", "job")
WORKDAY_FACETS = ("locationCountry", "Location_Country", "locationHierarchy1", "locations")
JOBVITE = rf"jobs\.jobvite\.com/(?:careers/)?({_SLUG})"
HOME_HOST = r"\.co\.il|\.org\.il"
ONE_PAGE_HOST = "adamtotal.co.il"


def board_from_url(url: Column) -> Column:
    """struct(kind, slug) of the first pattern whose slug is not a reserved word, else null."""
    tries = []
    for kind, pattern in BOARD_PATTERNS:
        slug = F.regexp_extract(url, f"(?i){pattern}", 1)
        tries.append(F.when((slug != "") & ~F.lower(slug).isin(*RESERVED_SLUGS),
                            F.struct(F.lit(kind).alias("kind"), slug.alias("slug"))))
    return F.coalesce(*tries)


def board_url(kind: Column, slug: Column) -> Column:
    """Public address of a board; other kinds carry their address as the slug."""
    shown = None
    for name, (head, tail) in BOARD_URLS.items():
        full = F.concat(F.lit(head), slug, F.lit(tail))
        shown = F.when(kind == name, full) if shown is None else shown.when(kind == name, full)
    return shown.otherwise(slug)


def boards_in_text(html: Column) -> Column:
    """Distinct boards whose address occurs in a text, also with JSON-escaped slashes."""
    urls = F.transform(F.regexp_extract_all(html, F.lit(BOARD_URL_IN_TEXT), F.lit(0)),
                       lambda u: board_from_url(F.replace(u, F.lit("\\/"), F.lit("/"))))
    return F.array_distinct(F.filter(urls, lambda b: b.isNotNull()))


def boards_in_page(pages: DataFrame) -> DataFrame:
    """(page columns but the html, kind, slug): found and made distinct inside the row, no shuffle."""
    kept = [c for c in pages.columns if c != "html"]
    found = pages.where(F.col("html").rlike(f"(?i){BOARD_HOSTS}")).select(
        *kept, F.explode(boards_in_text(F.col("html"))).alias("_b"))
    return found.select(*kept, "_b.kind", "_b.slug")


def comeet_page(url: Column) -> Column:
    """Normal form of a company page address, null when there is none."""
    uid = F.upper(F.regexp_extract(url, COMEET_PAGE, 2))
    return F.when(uid != "", F.concat(F.lit("https://www.comeet.com/jobs/"), F.regexp_extract(url, COMEET_PAGE, 1),
                                      F.lit("/"), uid))


def comeet_key(value: Column) -> Column:
    """Company id of a page address or an 'id|token' pair."""
    uid = F.regexp_extract(value, COMEET_PAGE, 2)
    return F.upper(F.when(uid != "", uid).otherwise(F.substring_index(value, "|", 1)))


def _starts(html: Column, pattern: str) -> Column:
    """Offsets at which the matches of a pattern start: the lengths of what is before them."""
    gaps = F.transform(F.split(html, pattern), F.length)
    sizes = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.length)
    # running sums: gap 0, then each match and the gap behind it
    steps = F.zip_with(sizes, F.slice(gaps, 2, 2_000_000_000), lambda size, gap: F.struct(
        size.alias("size"), F.coalesce(gap, F.lit(0)).alias("gap")))
    walked = F.aggregate(
        steps, F.struct(F.element_at(gaps, 1).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, s: F.struct((acc["at"] + s["size"] + s["gap"]).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"])
    return walked


def comeet_refs(html: Column) -> Column:
    """array<struct(kind, value)>: company pages, and the API pair of the page.

    The API address decides; without one the pair is the company id and the token written nearest to it.
    """
    page_urls = F.array_distinct(F.transform(
        F.regexp_extract_all(html, F.lit(COMEET_PAGE), F.lit(0)), comeet_page))
    pages = F.transform(page_urls, lambda u: F.struct(F.lit("page").alias("kind"), u.alias("value")))
    api = F.when(F.regexp_extract(html, COMEET_API, 2) != "", F.concat(
        F.upper(F.regexp_extract(html, COMEET_API, 1)), F.lit("|"), F.regexp_extract(html, COMEET_API, 2)))
    uid = F.upper(extract(html, COMEET_UID))
    uid_at = F.length(F.element_at(F.split(html, COMEET_UID, 2), 1))
    tokens = F.regexp_extract_all(html, F.lit(COMEET_TOKEN), F.lit(1))
    ranked = F.zip_with(_starts(html, COMEET_TOKEN), tokens, lambda at, token: F.struct(
        F.abs(at - uid_at).alias("distance"), at.alias("at"), token.alias("token")))
    nearest = F.concat(uid, F.lit("|"), F.array_min(ranked)["token"])
    pair = F.coalesce(api, F.when(uid.isNotNull() & (F.size(tokens) > 0), nearest))
    found = F.when(pair.isNull(), pages).otherwise(F.concat(pages, F.array(
        F.struct(F.lit("api").alias("kind"), pair.alias("value")))))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(F.lower(html).rlike("comeet|token"), found).otherwise(empty)


def workday_base(url: Column) -> Column:
    """Site root without the language segment; null for internal paths."""
    site = F.regexp_extract(url, WORKDAY, 3)
    return F.when((site != "") & ~site.isin(*WORKDAY_INTERNAL), F.concat(
        F.lit("https://"), F.regexp_extract(url, WORKDAY, 1), F.lit("."), F.regexp_extract(url, WORKDAY, 2),
        F.lit(".myworkdayjobs.com/"), site))


def workday_home_facets(payloads: DataFrame, home_pattern: str) -> DataFrame:
    """(payload columns but the body, facet, ids): the one facet that selects postings at home.

    The facet tree nests without a fixed depth: each step puts the values of an item behind it, so the list of items ends up in
    document order; there are as many steps as the text has lists of values. What isn't of the expected type - a payload that is no
    object, facets that are no list, an item that is no object, a descriptor that is no text - gives nothing.
    """
    def kind(v: Column, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))

    def field(v: Column, name: str) -> Column:
        return F.when(kind(v, "OBJECT"), F.try_variant_get(v, f"$.{name}", "variant"))

    def text(v: Column) -> Column:
        return F.when(kind(v, "STRING"), F.try_variant_get(v, "$", "string"))

    def items(v: Column) -> Column:
        return F.when(kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))

    def opened(values: Column, facet: Column) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("v"), F.when(
            field(v, "facetParameter").isNotNull(), text(field(v, "facetParameter"))).otherwise(facet).alias("facet"), F.lit(True).alias("todo")))

    none = F.array().cast("array<struct<v:variant,facet:string,todo:boolean>>")

    def step(at: Column, _: Column) -> Column:
        return F.flatten(F.transform(at, lambda x: F.when(x["todo"], F.concat(
            F.array(F.struct(x["v"].alias("v"), x["facet"].alias("facet"), F.lit(False).alias("todo"))),
            F.coalesce(opened(items(field(x["v"], "values")), x["facet"]), none))).otherwise(F.array(x))))

    tree = F.coalesce(opened(items(field(F.try_parse_json("body"), "facets")), F.lit(None).cast("string")), none)
    depth = F.size(F.regexp_extract_all("body", F.lit(r'"values"\s*:\s*\['), F.lit(0)))
    walked = F.aggregate(F.sequence(F.lit(0), F.greatest(depth, F.lit(0))), tree, lambda at, n: F.when(
        F.exists(at, lambda x: x["todo"]), step(at, n)).otherwise(at))
    number = F.try_variant_get  # an id may be written as a number
    hits = F.transform(
        F.filter(walked, lambda x: F.coalesce(text(field(x["v"], "descriptor")).rlike(f"(?i){home_pattern}"), F.lit(False))),
        lambda x: F.struct(x["facet"].alias("facet"), number(field(x["v"], "id"), "$", "string").alias("id")))
    hits = F.filter(hits, lambda h: h["facet"].isNotNull() & (F.coalesce(h["id"], F.lit("")) != ""))
    found = stage(payloads, _hits=hits).where(F.size("_hits") > 0)
    facets = F.transform("_hits", lambda h: h["facet"])
    named = [F.when(F.array_contains(facets, name), F.lit(name)) for name in WORKDAY_FACETS]
    found = stage(found, facet=F.coalesce(*named, F.get(F.filter(facets, lambda f: F.contains(F.lower(f), F.lit("location"))), 0)))
    ids = F.transform(F.filter("_hits", lambda h: h["facet"] == F.col("facet")), lambda h: h["id"])
    kept = [c for c in payloads.columns if c != "body"]
    return found.where("facet is not null").select(*kept, "facet", ids.alias("ids"))


def jobvite_rewrite(url: Column) -> Column:
    """The plain list instead of the scripted search page."""
    company = F.regexp_extract(url, JOBVITE, 1)
    return F.when(company != "", F.concat(F.lit("https://jobs.jobvite.com/"), company, F.lit("/jobs"))).otherwise(url)


def home_context(url: Column, given: Column | None = None) -> Column:
    """Whether the host places a source at home, unless the source says so itself."""
    by_host = authority(url).rlike(HOME_HOST)
    return by_host if given is None else F.coalesce(given, by_host)


def page_route(url: Column, html: Column, has_posting: Column) -> Column:
    """How a link is read, by precedence."""
    embedded = (F.size(boards_in_text(html)) > 0) | (F.size(comeet_refs(html)) > 0) | F.exists(
        F.regexp_extract_all(html, F.lit(WORKDAY), F.lit(0)), lambda u: workday_base(u).isNotNull())
    return (F.when(board_from_url(url).isNotNull(), "board")
            .when(url.rlike(COMEET_PAGE), "comeet")
            .when(workday_base(url).isNotNull(), "workday")
            .when(authority(url).contains(ONE_PAGE_HOST), "one_page")
            .when(embedded, "embedded")
            .when(has_posting, "posting")
            .otherwise("listing"))


# Fixed value: where a search page has its results.
SEARCH_RESULT = "li.b_algo a[href]"


def search_page_links(found: DataFrame) -> DataFrame:
    """(page columns but the html, pos, href): the links of the results on landed search pages, in page order; other links are left out."""
    from .pages import map_pages

    def read(root, _) -> list[tuple]:
        return [(place, node.attrs["href"]) for place, node in enumerate(root.select(SEARCH_RESULT))]

    return map_pages(found, T.StructType.fromDDL("pos long, href string"), read)


def search_result_links(results: DataFrame) -> DataFrame:
    """(result columns, target, kind, slug): boards behind the links of search pages, given as ``href`` or as landed pages (``html``)."""
    if "html" in results.columns:
        results = search_page_links(results)
    target = results.withColumn("target", search_result_target(F.col("href")))
    board = board_from_url(F.col("target"))
    page = extract(F.col("target"), rf"(https?://[^?#]*comeet\.com/jobs/[{WORD}\-]+/[{WORD}.]+)")
    return (target.withColumn("_b", F.coalesce(board, F.when(page.isNotNull(), F.struct(
        F.lit("comeet").alias("kind"), page.alias("slug")))))
        .select(*results.columns, "target", "_b.kind", "_b.slug"))


def board_has_home_jobs(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """(kind, slug, has_home_jobs): whether any posting of a board is at home by its location alone."""
    at_home = classify_location(F.col("location"), F.lit(""), F.lit(""), F.lit(False), rules)["decision"] == HOME
    return postings.groupBy("kind", "slug").agg(F.bool_or(at_home).alias("has_home_jobs"))
