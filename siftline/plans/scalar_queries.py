"""Queries over one row at a time: text, keys, dates, classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import companies, dates, places, text, titles, urls
from ..operators import cascade
from ..sources import boards
from . import driver_tables as D

c = F.col


def iso(date):
    return F.date_format(date, "yyyy-MM-dd")


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return D.postings(spark, sf)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return D.spread(D.table(spark, sf, "pages"), "page_id")


def html_to_text(spark, sf):
    return _pages(spark, sf).select("page_id", text.html_to_text(c("html")).alias("text"))


def normalize_text(spark, sf):
    doc = D.spread(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return doc.select("doc_id", text.normalize_text(c("text")).alias("normal"))


def fold_gender(spark, sf):
    return D.headings(spark, sf).select("doc_id", "pos", text.fold_gender(
        F.concat_ws(" ", "title", F.lit("מנהל/ת פיננסית")), D.rules()).alias("folded"))


def normalize_title(spark, sf):
    return D.headings(spark, sf).select("doc_id", "pos", text.normalize_title(c("title"), D.rules()).alias("normal_title"))


def fold_place_spelling(spark, sf):
    place = F.concat(F.lit("קרית "), c("location"), F.lit(", בקרית גת"))
    return D.places_of_customers(spark, sf).select("c_custkey", places.fold_place_spelling(place, D.rules()).alias("folded"))


def canonical_url(spark, sf):
    both = D.table(spark, sf, "pages").select("page_id", "url")
    tagged = both.select("page_id", F.explode(F.array(
        c("url"), F.concat(c("url"), F.lit("&z=%D7%90%20b&a=1+2&blank=")),
        F.concat(F.lit("https://il.linkedin.com/jobs/view/x-"), (c("page_id") + 10000000).cast("string"),
                 F.lit("?trk=1")))).alias("url"))
    return tagged.select("page_id", "url", urls.canonical_url(c("url")).alias("canonical"))


def split_locations(spark, sf):
    place = F.concat_ws(" | ", "location", F.lit("A / B or C; או"))
    parts = F.posexplode(places.split_locations(place)).alias("pos", "part")
    return D.places_of_customers(spark, sf).select("c_custkey", parts).select(
        "c_custkey", c("pos").cast("bigint").alias("pos"), "part")


def company_key(spark, sf):
    return D.company_names(spark, sf).select(
        "p_partkey", companies.company_key(c("company"), D.rules()).alias("company_key"))


def location_key(spark, sf):
    return D.places_of_customers(spark, sf).select("c_custkey", places.location_key(F.concat_ws(
        " ", "location", F.when(c("c_mktsegment") == "MACHINERY", F.lit("Tel Aviv District"))), D.rules()).alias("location_key"))


def job_keys(spark, sf):
    keys = companies.job_keys(c("url"), c("company"), c("title"), c("location"), D.rules())
    return _p(spark, sf).select("ord", *[v.alias(k) for k, v in keys.items()])


def slug_candidates(spark, sf):
    part = D.table(spark, sf, "part")
    name = F.concat(c("p_name"), F.lit(" Café "), c("p_brand"), F.lit(" (IL) Technologies Ltd"))
    return part.select("p_partkey", F.posexplode(text.slug_candidates(name)).alias("rank", "slug")).select(
        "p_partkey", c("rank").cast("bigint").alias("rank"), "slug")


def extract_experience(spark, sf):
    hint = F.when(c("ord") % 10 == 0, F.lit(" 5+ yrs ")).otherwise("")
    body = F.concat_ws(" ", "description", F.when(c("ord") % 3 == 0, F.lit("עם 2 עונות בגינה.")))
    return _p(spark, sf).select("ord", text.extract_experience(body, hint, D.rules()).alias("experience"))


def strip_sentences(spark, sf):
    return _p(spark, sf).select("ord", text.strip_sentences(c("description"), D.rules()).alias("text"))


def company_display_name(spark, sf):
    cust = D.table(spark, sf, "customer")
    slug = F.lower(F.translate("c_name", "#", "-"))
    hint = F.when(c("c_custkey") % 5 == 0, c("c_mktsegment"))
    api = F.when(c("c_custkey") % 3 == 0, slug).when(c("c_custkey") % 3 == 1, c("c_name"))
    return cust.select("c_custkey", text.company_display_name(hint, api, slug).alias("company"))


def parse_posting_date(spark, sf):
    r, as_of = D.rules(), D.as_of()
    return D.dated_orders(spark, sf).select(
        "o_orderkey", iso(dates.parse_posting_date(c("posted_raw"), as_of, r)).alias("posted"),
        iso(dates.parse_posting_date(c("updated_raw"), as_of, r)).alias("updated"))


def _dated(spark, sf):
    r, as_of = D.rules(), D.as_of()
    return D.dated_orders(spark, sf).select("o_orderkey", dates.relevant_date(
        dates.parse_posting_date(c("posted_raw"), as_of, r),
        dates.parse_posting_date(c("updated_raw"), as_of, r), as_of).alias("d"))


def relevant_date(spark, sf):
    return _dated(spark, sf).select("o_orderkey", iso(c("d")).alias("relevant"))


def freshness(spark, sf):
    fresh = dates.freshness(c("d"), D.as_of(), D.rules().fresh_days)
    return _dated(spark, sf).select("o_orderkey", F.when(fresh, "fresh").when(~fresh, "old").otherwise("unknown").alias("fresh"))


def date_display(spark, sf):
    return _dated(spark, sf).select("o_orderkey", dates.date_display(c("d")).alias("shown"))


def local_today(spark, sf):
    events = D.table(spark, sf, "events")
    # the table's times are UTC wall clock, whatever the session zone is
    return events.select("event_id", iso(dates.local_date(c("ts").cast("timestamp_ntz"), D.rules().business_zone)).alias("local_day"))


def title_class(spark, sf):
    return D.headings(spark, sf).select(
        "doc_id", "pos", F.coalesce(titles.title_class(c("title"), D.rules()), F.lit("-")).alias("class"))


def is_potential(spark, sf):
    return D.headings(spark, sf).select(
        "doc_id", "pos", titles.is_potential(titles.title_class(c("title"), D.rules())).alias("potential"))


def description_available(spark, sf):
    return _p(spark, sf).select("ord", cascade.description_available(c("description"), D.rules()).alias("available"))


def find_keywords(spark, sf):
    r = D.rules()
    return _p(spark, sf).select("ord", F.array_join(
        text.find_keywords(F.lower("description"), r), ", ").alias("keywords"))


def signal_score(spark, sf):
    r = D.rules()
    low = F.lower("description")
    return _p(spark, sf).select("ord", text.signal_score(low, r.analytics).cast("bigint").alias("analytics"),
                                text.signal_score(low, r.engineering).cast("bigint").alias("engineering"))


def role_essence(spark, sf):
    r = D.rules()
    return _p(spark, sf).select("ord", cascade.essence_of(
        titles.title_class(c("title"), r), F.lower("description"), r).alias("e")).select(
        "ord", c("e.ok").alias("ok"), c("e.reason").alias("reason"))


def classify_location(spark, sf):
    return _p(spark, sf).select("ord", places.classify_location(
        c("location"), c("description"), c("url"), c("ord") % 4 == 0, D.rules()).alias("p")).select(
        "ord", c("p.decision").alias("decision"), c("p.display").alias("display"), c("p.note").alias("note"))


def title_says_abroad(spark, sf):
    title = F.concat_ws(" ", "title", F.when(c("pos") % 5 == 0, F.lit("(Tel Aviv)")),
                        F.when(c("pos") % 7 == 0, F.lit("Relocation")))
    return D.headings(spark, sf).select("doc_id", "pos", places.title_says_abroad(title, D.rules()).alias("abroad"))


def company_sector(spark, sf):
    cust = D.table(spark, sf, "customer")
    company = D.cycle(D.COMPANIES, c("c_custkey"))
    listing = F.when(c("c_nationkey") % 4 == 0, F.lit("https://jobs.lever.co/x")).otherwise("https://x.example.com/")
    body = F.when(c("c_nationkey") % 3 == 0, F.lit("A SaaS startup, our platform is growing")).otherwise("We sell goods")
    industry = F.when(c("c_nationkey") % 2 == 0, c("c_mktsegment")).otherwise("")
    return cust.select("c_custkey", companies.company_sector(
        company, industry, listing, F.lit(""), body, D.rules()).alias("s")).select(
        "c_custkey", c("s.type").alias("type"), c("s.strength").alias("strength"))


def board_url(spark, sf):
    sup = D.table(spark, sf, "supplier")
    kind = D.cycle(boards.KINDS + ("workday",), c("s_suppkey"))
    return sup.select("s_suppkey", boards.board_url(kind, F.lower("s_name")).alias("board_url"))


def site_name(spark, sf):
    pages = D.table(spark, sf, "pages")
    known = F.concat(F.lit("https://"), D.cycle(("www", "careers", "il", "a.b"), c("page_id")), F.lit("."),
                     D.cycle(tuple(urls.SITE_NAMES) + ("example.com:8080",), c("page_id")), F.lit("/x"))
    return pages.select("page_id", urls.site_name(c("url")).alias("site"), urls.site_name(known).alias("known_site"))


def _board_urls():
    """Addresses of every form, cycled by a key."""
    return ("https://boards.greenhouse.io/embed/job_board?for={}&x=1", "https://job-boards.greenhouse.io/{}/jobs/1",
            "https://boards.eu.greenhouse.io/{}", "https://boards-api.greenhouse.io/v1/boards/{}/jobs",
            "https://jobs.lever.co/{}", "https://jobs.ashbyhq.com/{}%20x", "https://apply.workable.com/j/{}",
            "https://apply.workable.com/{}/", "https://JOBS.smartrecruiters.com/{}/77",
            "https://example.com/{}", "https://boards.greenhouse.io/embed?x={}", "https://jobs.lever.co/api")


def _address(forms):
    """The customer's name in an address whose form goes by the nation."""
    return F.replace(D.cycle(forms, c("c_nationkey")), F.lit("{}"), F.lower(F.translate("c_name", "#", "-")))


def board_from_url(spark, sf):
    b = boards.board_from_url(_address(_board_urls()))
    return D.table(spark, sf, "customer").select("c_custkey", F.coalesce(b["kind"], F.lit("-")).alias("kind"),
                      F.coalesce(b["slug"], F.lit("-")).alias("slug"))


def workday_base(spark, sf):
    forms = ("https://{}.wd3.myworkdayjobs.com/en-US/Careers/job/x", "https://{}.wd5.myworkdayjobs.com/External",
             "https://{}.wd5.myworkdayjobs.com/wday/cxs", "https://{}.example.com/en-US/Careers")
    return D.table(spark, sf, "customer").select("c_custkey", F.coalesce(boards.workday_base(_address(forms)), F.lit("-")).alias("base"))


def jobvite_rewrite(spark, sf):
    forms = ("https://jobs.jobvite.com/careers/{}/search?q=1", "https://jobs.jobvite.com/{}", "https://x.example.com/{}")
    return D.table(spark, sf, "customer").select("c_custkey", boards.jobvite_rewrite(_address(forms)).alias("url"))


def home_context(spark, sf):
    pages = D.table(spark, sf, "pages")
    local = F.when(c("page_id") % 3 == 0, F.replace("url", F.lit(".example."), F.lit(".co.il.example."))).otherwise(c("url"))
    given = F.when(c("page_id") % 5 == 0, F.lit(True))
    return pages.select("page_id", boards.home_context(local).alias("by_host"),
                        boards.home_context(local, given).alias("home_context"))


def search_result_links(spark, sf):
    cust = D.table(spark, sf, "customer")
    url = _address(_board_urls() + ("https://www.comeet.com/jobs/{}/12.34A?x=1",))
    code = F.regexp_replace(F.translate(F.base64(url.cast("binary")), "+/", "-_"), "[=\r\n]+", "")
    href = F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("https://www.bing.com/ck/a?p=1&u=a1"), code, F.lit("&ntb=1")))\
        .otherwise(url)
    # landed result pages: one result, and links that are none
    html = F.concat(F.lit('<header><a href="https://jobs.lever.co/menu">m</a></header><ol><li class="b_ad"><a href="https://jobs.lever.co/ad">ad</a></li>'
                          '<li class="b_algo x"><h2><a href="'), F.replace(href, F.lit("&"), F.lit("&amp;")), F.lit('">t</a></h2></li></ol>'))
    out = boards.search_result_links(cust.select("c_custkey", html.alias("html")))
    return out.select("c_custkey", "target", F.coalesce("kind", F.lit("-")).alias("kind"),
                      F.coalesce("slug", F.lit("-")).alias("slug"))


def evaluate(spark, sf):
    out = cascade.evaluate(_p(spark, sf), D.as_of(), D.rules())
    return out.select("ord", "accepted", "outcome", iso(c("seen_date")).alias("seen"), "key",
                      F.coalesce("alt_key", F.lit("")).alias("alt_key"), F.coalesce("why", F.lit("")).alias("why"),
                      F.coalesce("experience", F.lit("")).alias("experience"),
                      F.coalesce("date_display", F.lit("")).alias("date_display"))


QUERIES = {f.__name__: f for f in (
    html_to_text, normalize_text, fold_gender, normalize_title, fold_place_spelling, canonical_url, split_locations,
    company_key, location_key, job_keys, slug_candidates, extract_experience, strip_sentences, company_display_name,
    parse_posting_date, relevant_date, freshness, date_display, local_today, title_class, is_potential,
    description_available, find_keywords, signal_score, role_essence, classify_location, title_says_abroad,
    company_sector, board_url, site_name, board_from_url, workday_base, jobvite_rewrite, home_context,
    search_result_links, evaluate)}

