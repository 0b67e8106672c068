"""Queries over landed files, payloads and pages, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import vocabulary
from ..sources import boards, links, pages as P, payloads
from . import driver_tables as D

c = F.col
lit = F.lit


def text(name):
    return (F.col(name) if isinstance(name, str) else name).cast("string")


def cat(*parts):
    return F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])


def _pages(spark, sf):
    return D.spread(D.table(spark, sf, "pages"), "page_id")


def _orders(spark, sf):
    return D.spread(D.table(spark, sf, "orders"), "o_orderkey").select(
        text("o_orderkey").alias("k"), text("o_custkey").alias("cust"), "o_orderkey", "o_custkey", "o_orderstatus",
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# ---------------------------------------------------------------- link files
def _link_files(spark, sf):
    page = text("page_id")
    return D.table(spark, sf, "pages").select(
        cat("f", F.lpad(page, 9, "0")).alias("path"),
        F.concat_ws("\n", cat("# page ", page, " https://comment.example.com"), lit(""), cat("  ", c("url"), ")."),
                    cat("site", page, ".co.il/careers"),
                    cat("1. https://jobs.lever.co/x", text(c("page_id") % 7), "?utm_source=1, https://www.max.co.il/", page),
                    lit("no link here")).alias("value"))


def src_link_list(spark, sf):
    return links.link_list(_link_files(spark, sf)).select(
        "path", c("line").cast("bigint").alias("line"), c("pos").cast("bigint").alias("pos"), "url")


def link_dedupe_by_site(spark, sf):
    return links.link_dedupe_by_site(links.link_list(_link_files(spark, sf))).select("identity", "path", "url")


# ---------------------------------------------------------------- vocabularies
def terms_to_matcher(spark, sf):
    part = D.table(spark, sf, "part")
    vocab = part.select(c("p_type").alias("list"), F.explode(F.array(
        c("p_name"), cat(c("p_name"), " & (", c("p_brand"), ")"))).alias("term"))
    everything = part.select(lit("all").alias("list"), cat(c("p_name"), " ", text("p_partkey")).alias("term"))
    return vocabulary.terms_to_matcher(vocab.unionByName(everything))


def match_terms(spark, sf):
    """Words and word pairs of the benchmark passages, looked up in all documents."""
    words = F.split(normalize_text(c("text")), " ")
    bench = D.table(spark, sf, "benchmark").select(words.alias("w"))
    pairs = F.transform(F.sequence(lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))
    vocab = bench.select(lit("word").alias("list"), F.explode("w").alias("term")).unionByName(
        bench.where(F.size("w") > 1).select(lit("pair").alias("list"), F.explode(pairs).alias("term")))
    doc = D.spread(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return vocabulary.match_terms(doc, "text", vocab, "doc_id")


# ---------------------------------------------------------------- payloads
def flatten_payload_greenhouse(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        c("o_orderkey").alias("id"), cat("Analyst ", c("o_orderpriority")).alias("title"),
        cat("https://boards.greenhouse.io/b", c("cust"), "/jobs/", c("k")).alias("absolute_url"),
        F.struct(cat("City ", c("cust")).alias("name")).alias("location"),
        cat("&lt;p&gt;Order &amp;amp; ", c("k"), "&lt;/p&gt;&lt;ul&gt;&lt;li&gt; prio ", c("o_orderpriority"),
            "&lt;/li&gt;&lt;/ul&gt;").alias("content"),
        c("day").alias("first_published"), cat(c("day"), "T10:00:00Z").alias("updated_at"))
    two = F.struct((c("o_orderkey") + 1_000_000).alias("id"), lit("No place").alias("title"))
    # the two postings have different fields, as real payloads do
    body = cat('{"name":"Board ', c("cust"), '","jobs":[', F.to_json(one), ",", F.to_json(two), "]}")
    # every third customer's board has a payload of its own with a better name
    own = o.where(c("o_custkey") % 3 == 0).select(cat("b", c("cust")).alias("slug"), F.to_json(F.struct(
        cat("Company ", c("cust")).alias("name"))).alias("body"))
    flat = payloads.flatten_greenhouse(o.select(cat("b", c("cust")).alias("slug"), body.alias("body")))
    return payloads.named_boards(flat, payloads.board_names(own))


def flatten_payload_lever(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        cat("Analyst ", c("k")).alias("text"), cat("https://jobs.lever.co/s/", c("k")).alias("hostedUrl"),
        F.when(c("o_orderstatus") == "O", "IL").otherwise("US").alias("country"),
        (c("o_orderkey") * 1000 + 1790000000000).alias("createdAt"), c("k").alias("id"),
        F.struct(lit("Single").alias("location"), F.when(c("o_custkey") % 2 == 0, F.array(
            lit("Haifa"), lit(""), cat("Town ", c("cust")))).alias("allLocations")).alias("categories"),
        lit("Plain start").alias("descriptionPlain"), lit("The end").alias("additionalPlain"),
        F.array(F.struct(lit("Needs").alias("text"), cat("<li>SQL ", c("k"), "</li><li>more</li>").alias("content"))).alias("lists"))
    return payloads.flatten_lever(o.select(cat("s", c("cust")).alias("slug"), cat("[", F.to_json(one), "]").alias("body")))


def flatten_payload_ashby(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        cat("Analyst ", c("k")).alias("title"), cat("https://jobs.ashbyhq.com/s/", c("k")).alias("jobUrl"),
        lit("Tel Aviv").alias("location"),
        F.when(c("o_custkey") % 3 == 0, F.array(F.struct(lit("Remote Europe").alias("location")))).alias("secondaryLocations"),
        F.struct(F.struct(F.when(c("o_custkey") % 2 == 0, "Israel").alias("addressCountry")).alias("postalAddress")).alias("address"),
        (c("o_orderstatus") != "F").alias("isRemote"),
        F.when(c("o_orderstatus") == "O", cat("Plain ", c("k"))).alias("descriptionPlain"),
        cat("<p>Rich ", c("k"), "</p>").alias("descriptionHtml"), c("day").alias("publishedAt"), c("k").alias("id"))
    return payloads.flatten_ashby(o.select(cat("s", c("cust")).alias("slug"), cat('{"jobs":[', F.to_json(one), "]}").alias("body")))


def flatten_payload_workable(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        cat("Analyst ", c("k")).alias("title"), cat("SC", c("k")).alias("shortcode"), (c("o_orderstatus") == "P").alias("remote"),
        c("day").alias("published"), F.struct(lit("Lod").alias("city"), lit("Israel").alias("country")).alias("location"),
        F.when(c("o_custkey") % 2 == 0, F.array(
            F.struct(lit("Haifa").alias("city"), lit("Israel").alias("country")),
            F.struct(lit("").alias("city"), lit("France").alias("country")))).alias("locations"))
    rows = payloads.flatten_workable(o.select(cat("s", c("cust")).alias("slug"), cat('{"results":[', F.to_json(one), "]}").alias("body")))
    accounts = o.where(c("o_custkey") % 3 == 0).select(cat("s", c("cust")).alias("slug"), F.to_json(F.struct(
        cat("Company ", c("cust")).alias("name"))).alias("body"))
    rows = payloads.named_boards(rows, payloads.board_names(accounts))
    detail = o.where("o_orderstatus <> 'F'").select(
        cat("s", c("cust")).alias("slug"), cat("SC", c("k")).alias("job_id"), F.to_json(F.struct(
            cat("<p>About ", c("k"), "</p>").alias("description"), lit("").alias("requirements"),
            lit("<b>Perks</b>").alias("benefits"))).alias("body"))
    found, missing = payloads.detail_join(rows.drop("description"), payloads.workable_details(detail), ["slug", "job_id"])
    flat = found.select(*payloads.FLAT)
    return flat.unionByName(missing.select("slug", *[lit("").alias(n) for n in payloads.FLAT if n not in ("slug", "job_id")],
                                           text("missing").alias("job_id")))


def flatten_payload_smartrecruiters(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        c("k").alias("id"), cat("Analyst ", c("k")).alias("name"), c("day").alias("releasedDate"),
        F.struct(F.when(c("o_custkey") % 2 == 0, cat("Company ", c("cust"))).alias("name")).alias("company"),
        F.struct(lit("Haifa").alias("city"), F.when(c("o_orderstatus") == "O", "il").otherwise("fr").alias("country")).alias("location"))
    rows = payloads.flatten_smartrecruiters(o.select(cat("s", c("cust")).alias("slug"),
                                                     cat('{"content":[', F.to_json(one), "]}").alias("body")))
    section = F.struct(cat("<p>Do ", c("k"), "</p>").alias("text"))
    detail = o.select(cat("s", c("cust")).alias("slug"), c("k").alias("job_id"), F.to_json(F.struct(F.struct(F.struct(
        F.struct(lit("About us").alias("text")).alias("companyDescription"), section.alias("jobDescription"),
        F.struct(lit("SQL").alias("text")).alias("qualifications")).alias("sections")).alias("jobAd"))).alias("body"))
    found, _ = payloads.detail_join(rows.drop("description"), payloads.smartrecruiters_details(detail), ["slug", "job_id"])
    return found.select(*payloads.FLAT)


def flatten_payload_comeet(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        cat("Analyst ", c("k")).alias("name"), c("k").alias("uid"),
        F.when(c("o_custkey") % 3 == 0, "Own name").alias("company_name"), c("day").alias("time_updated"),
        F.when(c("o_custkey") % 2 == 0, cat("https://www.comeet.com/jobs/a/12.345/", c("k"))).alias("url_comeet_hosted_page"),
        F.when(c("o_orderstatus") != "P", cat("https://x.example.com/", c("k"))).alias("url_active_page"),
        F.struct(cat("Office ", c("cust")).alias("name"), F.when(c("o_orderstatus") == "O", "Haifa").alias("city"),
                 F.when(c("o_orderstatus") == "O", "IL").alias("country")).alias("location"),
        F.array(F.struct(lit("d").alias("name"), cat("<p>Do [", c("k"), "]; then more</p>").alias("value")),
                F.struct(lit("r").alias("name"), lit("SQL").alias("value"))).alias("details"))
    html = cat('<script>COMPANY_DATA = {"name": "Comp ', c("cust"), '", "x": 1};\n COMPANY_POSITIONS_DATA = [', F.to_json(one),
               "];\nvar after = [1];</script>")
    pages = o.select(cat("12.", c("cust")).alias("slug"), html.alias("html"))
    return payloads.flatten_comeet(payloads.comeet_positions(pages))


def flatten_payload_workday(spark, sf):
    o = _orders(spark, sf)
    base = cat("https://t.wd3.myworkdayjobs.com/S", c("cust"))
    lists = o.select(base.alias("slug"), cat('{"jobPostings":[', F.to_json(F.struct(
        cat("Analyst ", c("k")).alias("title"), cat("/job/", c("k")).alias("externalPath"), lit("Posted Today").alias("postedOn"))),
        ',{"title":"no path"}]}').alias("body"))
    details = o.where("o_orderstatus <> 'F'").select(base.alias("slug"), cat("/job/", c("k")).alias("path"), F.to_json(F.struct(
        F.struct(lit("Haifa").alias("location"), F.struct(lit("Israel").alias("descriptor")).alias("country"),
                 F.when(c("o_custkey") % 2 == 0, cat("https://ext.example.com/", c("k"))).alias("externalUrl"),
                 cat("<p>Text ", c("k"), "</p>").alias("jobDescription"),
                 F.when(c("o_custkey") % 3 == 0, c("day")).alias("startDate"), c("k").alias("jobReqId")).alias("jobPostingInfo")))
        .alias("body"))
    flat, missing = payloads.flatten_workday(lists, details)
    return flat.unionByName(missing.select("slug", *[lit("").alias(n) for n in payloads.FLAT if n not in ("slug", "job_id")],
                                           text("missing").alias("job_id")))


def flatten_payload_drushim(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(
        c("k").alias("Code"),
        F.struct(F.when(c("o_orderstatus") != "P", cat("/job/", c("k"), "/")).alias("Link"), c("day").alias("Date"),
                 lit("2026-09-01").alias("JumpDate")).alias("JobInfo"),
        F.struct(cat("Analyst ", c("k")).alias("Name"), F.when(c("o_custkey") % 2 == 0, F.array(
            *[F.struct(lit(x).alias("City")) for x in ("חיפה", "", "לוד", "חיפה")])).alias("Addresses"),
            F.array(F.struct(lit("מרכז").alias("NameInHebrew")), F.struct(lit("צפון").alias("NameInHebrew"))).alias("Zones"),
            F.struct(lit("3 שנים").alias("NameInHebrew")).alias("Experience")).alias("JobContent"),
        F.struct(F.when(c("o_custkey") % 3 == 0, cat("Comp ", c("cust"))).alias("CompanyDisplayName"),
                 lit("חברה").alias("NameInHebrew")).alias("Company"))
    return payloads.flatten_drushim(o.select(lit("q").alias("slug"), cat('{"ResultList":[', F.to_json(one), "]}").alias("body")))


def flatten_embedded_state_json(spark, sf):
    o = _orders(spark, sf)
    one = F.struct(F.when(c("o_custkey") % 2 == 0, cat("Shown ", c("k"))).alias("displayTitle"), cat("Analyst ", c("k")).alias("title"),
                   c("k").alias("jobkey"), cat("Comp ", c("cust")).alias("company"), lit("Haifa").alias("formattedLocation"),
                   lit("3 days ago").alias("formattedRelativeTime"))
    html = cat('<script>window.mosaic.providerData["mosaic-provider-jobcards"] = {"metaData":{"mosaicProviderJobCardsModel":'
               '{"results":[', F.to_json(one), ',{"title":"no key"}]}}};\nwindow.x = {};</script>')
    return payloads.flatten_embedded_cards(o.select(lit("q").alias("slug"), html.alias("html")))


# ---------------------------------------------------------------- boards in pages
def _board_pages(spark, sf):
    extra = cat('<a href="https://boards.greenhouse.io/co-', text(c("page_id") % 9), '/jobs/1">x</a>',
                F.when(c("page_id") % 3 == 0, cat('<script>{"u":"https:\\/\\/jobs.lever.co\\/co-', text(c("page_id") % 5),
                                                 '\\/1", "v":"https://jobs.lever.co/co-', text(c("page_id") % 5), '?x"}</script>'))
                .otherwise(""), '<iframe src="https://boards.greenhouse.io/embed/job_board?for=emb', text("page_id"), '"></iframe>')
    return _pages(spark, sf).select("page_id", "url", cat(c("html"), extra).alias("html"))


def boards_in_page(spark, sf):
    return boards.boards_in_page(_board_pages(spark, sf)).select("page_id", "kind", "slug")


def _token(salt: int):
    return F.lpad(F.hex(c("page_id") + salt), 20, "A")


def comeet_refs(spark, sf):
    far = cat('{"token":"', _token(7), '"}', F.repeat(lit(" ."), 50))
    near = cat('COMEET.init({token:"', _token(1), '","company-uid":"8A.00', text(c("page_id") % 10), '"})')
    api = cat("var u='https://www.comeet.co/careers-api/2.0/company/B3.00", text(c("page_id") % 10), "/positions/?token=",
              _token(3), "&details=true';")
    link = cat('<a href="https://www.comeet.com/jobs/co', text("page_id"), '/1a.00', text(c("page_id") % 10), '">')
    html = F.when(c("page_id") % 4 == 0, cat(far, near)).when(c("page_id") % 4 == 1, cat(near, api)).when(
        c("page_id") % 4 == 2, cat(link, link, far)).otherwise("")
    refs = _pages(spark, sf).select("page_id", F.explode(boards.comeet_refs(cat(c("html"), html))).alias("r"))
    return refs.select("page_id", "r.kind", "r.value")


def workday_home_facets(spark, sf):
    cust = D.table(spark, sf, "customer")
    k = text("c_custkey")
    country = F.when(c("c_custkey") % 3 == 0, cat(',{"facetParameter":"locationCountry","values":[{"id":"il', k,
                                                 '","descriptor":"Israel"},{"id":"fr","descriptor":"France"}]}')).otherwise("")
    place = F.when(c("c_custkey") % 3 < 2, cat('{"facetParameter":"officeLocation","values":[{"id":"g","descriptor":"Group",'
                                              '"values":[{"id":"h', k, '","descriptor":"Haifa"},{"id":"b","descriptor":"Berlin"},'
                                              '{"id":"t', k, '","descriptor":"Tel Aviv"}]}]}'))\
        .otherwise('{"facetParameter":"jobFamily","values":[{"id":"x","descriptor":"Haifa"}]}')
    body = cat('{"facets":[', place, country, "]}")
    out = boards.workday_home_facets(cust.select("c_custkey", body.alias("body")), "israel|tel aviv|haifa")
    return out.select("c_custkey", "facet", F.array_join("ids", ",").alias("ids"))


def page_route(spark, sf):
    urls = ("https://jobs.lever.co/a", "https://www.comeet.com/jobs/a/12.345", "https://a.wd1.myworkdayjobs.com/en-US/S",
            "https://career.adamtotal.co.il/x", "https://a.example.com/1", "https://a.example.com/2", "https://a.example.com/3")
    html = F.when(c("page_id") % 7 == 4, cat(c("html"), "https://jobs.lever.co/zz")).otherwise(c("html"))
    route = boards.page_route(D.cycle(urls, c("page_id")), html, c("page_id") % 7 == 5)
    return _pages(spark, sf).select("page_id", route.alias("route"))


# ---------------------------------------------------------------- structured data and lines
def _ld_pages(spark, sf):
    page = text("page_id")
    posting = cat('{"@type":"JobPosting","title":"Analyst &amp; more ', page, '","description":"<p>Do &lt;b&gt;SQL</p>\\n<p>',
                  page, '</p>","datePosted":"2026-09-', F.lpad(text(c("page_id") % 28 + 1), 2, "0"), '",'
                  '"hiringOrganization":{"@type":"Organization","name":"Org ', text(c("page_id") % 13), '"},'
                  '"jobLocation":[{"address":{"addressLocality":"Haifa","addressRegion":"","addressCountry":"IL"}},'
                  '{"address":{"addressLocality":"Paris","addressCountry":{"@type":"Country","name":"France"}}}]}')
    other = '{"@type":"WebSite","name":"x"}'
    older = '{"@type":["Thing","JobPosting"],"title":"First in list"}'
    body = (F.when(c("page_id") % 4 == 0, posting)
            .when(c("page_id") % 4 == 1, cat(F.repeat(lit("["), 30), older, ",", other, ",", posting, F.repeat(lit("]"), 30)))
            .when(c("page_id") % 4 == 2, cat('{"@context":"x","@graph":[', older, ",", posting, ",", other, "]}"))
            .otherwise(cat("{broken", posting)))
    script = cat('<script type="application/ld+json">', body, "</script>")
    return _pages(spark, sf).select("page_id", "url", cat(c("html"), script).alias("html"))


def extract_jsonld_posting(spark, sf):
    return P.extract_jsonld_posting(_ld_pages(spark, sf)).select(
        "page_id", "title", "company", "description", "location", "posted", "updated")


def jsonld_location(spark, sf):
    k = cat(c("c_mktsegment"), " ", text("c_custkey"))
    forms = (
        '{"jobLocation":{"address":{"addressLocality":"Town #","addressRegion":"R","addressCountry":"ISR"}}}',
        '{"jobLocationType":"TELECOMMUTE","applicantLocationRequirements":{"@type":"Country","name":"United States"}}',
        '{"jobLocationType":"TELECOMMUTE","applicantLocationRequirements":[{"name":"France"},{"name":"Spain #"}]}',
        '{"jobLocationType":"TELECOMMUTE"}', '{"title":"no place"}',
        '{"jobLocation":["Lod",{"address":"Street #"},{"address":[{"addressCountry":["IL","FR"]}]}]}',
        '{"jobLocationType":"TELECOMMUTE","jobLocation":{"address":{"addressLocality":"Eilat"}}}')
    body = F.parse_json(F.replace(D.cycle(forms, c("c_nationkey")), lit("#"), k))
    return D.table(spark, sf, "customer").select("c_custkey", P.jsonld_location(body).alias("location"))


def _labelled(column):
    extra = cat("<div>Location:&nbsp;</div><div>Town ", text(c("page_id") % 11), " | full time</div><p>City: Later</p>"
                "<p>Posted: soon</p><p>Date posted: ", text(c("page_id") % 20 + 1), " days ago</p>")
    return cat(column, F.when(c("page_id") % 3 < 2, extra).otherwise(cat("<p>", F.repeat(lit("long "), 20), "Location: x</p>")))


def labeled_fields(spark, sf):
    rows = _pages(spark, sf).select("page_id", P.labeled_fields(_labelled(c("html")), D.as_of(), D.rules()).alias("f"))
    return rows.select("page_id", "f.location", "f.posted")


# ---------------------------------------------------------------- links
def _listing_pages(spark, sf):
    page = text("page_id")
    good = cat('<a href="/jobs/view-', page, '/">Kitchen Gardener</a><A class="x" HREF=\'/jobs/view-', page,
               '/#apply\'>Senior <b>Kitchen</b> Gardener</a><a title="Rose Gardener" href="../careers/', page, '12345?x=1&amp;y=2"></a>'
               '<a href="https://other.example.org/job/77777">Kitchen Gardener</a>'
               '<a href="https://jobs.lever.co/z', page, '/12">Market Gardener</a><a href="//cdn.example.com/job/1">Kitchen Gardener</a>')
    plain = cat('<a href="/jobs/driver-', page, '0000">Driver</a><a href="/jobs/nurse-', page, '0000">Nurse</a>')
    extra = F.when(c("page_id") % 3 == 0, cat(good, plain)).when(c("page_id") % 3 == 1, plain).otherwise("")
    return _pages(spark, sf).select("page_id", "url", cat(c("html"), extra).alias("html"))


def extract_links(spark, sf):
    out = P.extract_links(P.page_anchors(_listing_pages(spark, sf)), D.rules())
    return out.select("page_id", "href", "text")


def page_yield_status(spark, sf):
    pages = _listing_pages(spark, sf)
    return P.page_yield_status(pages, P.page_anchors(pages), D.rules())


# ---------------------------------------------------------------- selector jobs
def _card_pages(spark, sf):
    """List pages of every board, cycled by the order."""
    k, status = c("k"), c("o_orderstatus")
    linkedin = cat('<ul><li><div data-entity-urn="urn:li:job:', k, '"><h3> Analyst <b>', k, '</b></h3><h4>Comp ', c("cust"),
                   '</h4><span class="a job-search-card__location">Haifa</span><time datetime="', c("day"), '">x</time></div>'
                   '<li><p>no card</p></ul>')
    alljobs = cat('<div class="', F.when(status == "O", "open-board").otherwise("organic-board"), '" id="job-box-container', k,
                  '"><div class="job-content-top-title-ltr"><a href="/Search/UploadSingle.aspx?JobID=', k, '"><h2>Analyst ', k,
                  '</h2></a></div><div class="job-content-top-location">Location: Haifa</div></div>')
    secret = cat('<div class="wpjb-grid-row"><div class="wpjb-col-title"><a href="https://s.example.com/job/', k, '/">Analyst ', k,
                 '</a><span class="wpjb-sub">Comp ', c("cust"), '</span></div><div class="wpjb-col-location">'
                 '<span class="wpjb-glyphs">Lod &amp; Haifa</span></div></div>')
    jobmaster = cat('<article class="JobItem" id="misra', k, '"><a class="CardHeader">Analyst <b>', k, '</b></a><span class="CompanyNameLink">Comp ',
                    c("cust"), '</span><div class="jobLocation">Haifa</div><div class="paddingTop10px"><span class="Gray">', c("day"),
                    "</span></div></article>")
    adamtotal = cat('<div class="job-card-logo"><img alt="לוגו Comp ', c("cust"), ', join us"></div><article class="job-card" data-job-title="Analyst ',
                    k, '"><div class="job-meta"><span><i class="fas fa-map-marker-alt"></i>Haifa</span></div><a class="job-detail-link" href="/Jobs/', k,
                    '">x</a><div class="description-text"><p>Do SQL</p></div></article><article class="job-card" data-job-title="No link"></article>')
    by_board = dict(linkedin=linkedin, alljobs=alljobs, secret=secret, jobmaster=jobmaster, adamtotal=adamtotal)
    board = D.cycle(tuple(by_board), c("o_orderkey"))
    html = F.coalesce(*[F.when(board == name, page) for name, page in by_board.items()])
    return _orders(spark, sf).select("k", "o_orderkey", board.alias("board"), html.alias("html"))


def extract_cards(spark, sf):
    cards = P.extract_cards(_card_pages(spark, sf), P.CARD_BOARDS)
    return cards.select("k", c("board").alias("board_name"), "job_id", "title", "company", "location", "date_text", "description", "closed")


def extract_detail_page(spark, sf):
    o = _orders(spark, sf)
    body = cat('<h2 class="top-card-layout__title">Analyst ', c("k"), '</h2><span class="posted-time-ago__text"> 3 days ago </span>'
               '<div class="show-more-less-html__markup"><p>Do SQL ', c("k"), "</p><script>no()</script><p>More</p></div>"
               '<li class="description__job-criteria-item"><h3>Seniority level</h3>'
               '<span class="description__job-criteria-text">', F.when(c("o_orderstatus") == "O", "Not Applicable").otherwise("Senior"),
               '</span></li><li class="description__job-criteria-item"><h3>Industries</h3>'
               '<span class="description__job-criteria-text">Banking</span></li>')
    html = F.when(c("o_custkey") % 5 == 0, "<p>no description</p>").otherwise(body)
    return P.extract_detail_page(o.select("k", html.alias("html")))


def main_content_text(spark, sf):
    return P.main_content_text(_pages(spark, sf).select("page_id", "html"))


def posting_from_page(spark, sf):
    doc = D.spread(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    safe = F.replace(F.replace(F.replace("text", lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    html = cat('<html><head><meta property="og:site_name" content="Site ', text(c("doc_id") % 9), '"></head><body><nav>Menu</nav>'
               "<h1>Analyst ", text("doc_id"), '</h1><div class="cookie-bar">We use cookies</div><div class="description"><p>', safe,
               "</p><p>", F.repeat(lit("filler "), 40), "</p></div><p>Location: Haifa</p><p>Date posted: 2026-09-20</p></body></html>")
    pages = doc.select("doc_id", cat("https://c.example.com/", text("doc_id")).alias("url"), html.alias("html"))
    out = P.posting_from_page(pages, D.as_of(), D.rules())
    return out.select("doc_id", "title", "company", "description", "location", "posted_raw", "updated_raw")


QUERIES = {f.__name__: f for f in (
    terms_to_matcher, match_terms, src_link_list, link_dedupe_by_site, flatten_payload_greenhouse, flatten_payload_lever, flatten_payload_ashby,
    flatten_payload_workable, flatten_payload_smartrecruiters, flatten_payload_comeet, flatten_payload_workday,
    flatten_payload_drushim, flatten_embedded_state_json, boards_in_page, comeet_refs, workday_home_facets, page_route,
    extract_jsonld_posting, jsonld_location, labeled_fields, extract_links, page_yield_status, extract_cards,
    extract_detail_page, main_content_text, posting_from_page)}
