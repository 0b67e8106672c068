import json

from pyspark.sql import functions as F

from siftline.sources import boards, links, pages, payloads
from siftline.sources.nodes import parse


def test_link_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿\n  https://a.com/careers  \n# https://no.com\nhttps://a.com/jobs\r\n\nb.co.il/jobs\n"
                                    "https://jobs.lever.co/x?utm_source=1\nhttps://jobs.lever.co/x\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("1. https://www.a.com/other).\nhttps://jobs.lever.co/y, see https://c.com\nplain words\n",
                                    encoding="utf-8")
    (tmp_path / "c.md").write_text("https://ignored.com", encoding="utf-8")
    found = links.link_list(links.read_link_files(spark, str(tmp_path)))
    rows = found.orderBy("path", "line", "pos").collect()
    assert [r.url for r in rows] == ["https://a.com/careers", "https://a.com/jobs", "https://b.co.il/jobs",
                                     "https://jobs.lever.co/x?utm_source=1", "https://jobs.lever.co/x", "https://www.a.com/other",
                                     "https://jobs.lever.co/y", "https://c.com"]
    one = links.link_dedupe_by_site(found).orderBy("path", "line", "pos").collect()
    assert [r.url for r in one] == ["https://a.com/careers", "https://b.co.il/jobs", "https://jobs.lever.co/x?utm_source=1",
                                    "https://jobs.lever.co/y", "https://c.com"]


def test_board_addresses(ask):
    rows = {"https://boards.greenhouse.io/embed/job_board?for=co": ("greenhouse", "co"),
            "https://boards.greenhouse.io/embed/job_board/js?for=co": ("greenhouse", "co"),
            "https://job-boards.eu.greenhouse.io/co/jobs/1": ("greenhouse", "co"),
            "https://boards-api.greenhouse.io/v1/boards/co/jobs": ("greenhouse", "co"),
            "https://boards.greenhouse.io/embed/other": None, "https://jobs.lever.co/co.x/1": ("lever", "co.x"),
            "https://apply.workable.com/j/123": None, "https://CAREERS.smartrecruiters.com/Co": ("smartrecruiters", "Co"),
            "https://jobs.ashbyhq.com/a%20b": ("ashby", "a%20b"), "https://x.com": None}
    out = [r["b"] for r in ask(list(rows), "u string", b=boards.board_from_url(F.col("u")))]
    assert [(b["kind"], b["slug"]) if b else None for b in out] == list(rows.values())


def test_comeet(ask):
    html = ["u='https://www.comeet.co/careers-api/2.0/company/C4.117/positions/?token=0A1B2C3D4E5F60718293&x=1'",
            'init({token:"1122334455667788AABB","company-uid":"D5.224"})',
            '{"token":"abcdef0123456789abcdef01"} UID; COMPANY_UID = \'E6.335\'; TOKEN = \'99887766554433221100\';',
            r'{\"companyUid\":\"F7.446\",\"token\":\"0F1E2D3C4B5A69788796\"}',
            '{"token":"AAAAAAAAAAAAAAAAAAAA"}' + " " * 80 + '"company-uid":"D5.224", "token":"BBBBBBBBBBBBBBBBBBBB"',
            '<a href="https://www.comeet.com/jobs/co/1a.00b">', "nothing", ""]
    out = [r["c"] for r in ask(html, "h string", c=boards.comeet_refs(F.col("h")))]
    assert [[(x["kind"], x["value"]) for x in r] for r in out] == [
        [("api", "C4.117|0A1B2C3D4E5F60718293")], [("api", "D5.224|1122334455667788AABB")],
        [("api", "E6.335|99887766554433221100")], [("api", "F7.446|0F1E2D3C4B5A69788796")],
        [("api", "D5.224|BBBBBBBBBBBBBBBBBBBB")], [("page", "https://www.comeet.com/jobs/co/1A.00B")], [], []]
    assert ask(["https://www.comeet.com/jobs/co/1a.00b", "1a.00b|TOKEN"], "h string", c=boards.comeet_key(F.col("h"))) == [
        {"c": "1A.00B"}, {"c": "1A.00B"}]


def test_workday(ask, spark):
    rows = ["https://t.wd3.myworkdayjobs.com/en-US/Careers/job/1", "https://t.wd3.myworkdayjobs.com/wday/x", "https://x.com"]
    assert [r["b"] for r in ask(rows, "u string", b=boards.workday_base(F.col("u")))] == [
        "https://t.wd3.myworkdayjobs.com/Careers", None, None]
    deep = {"id": "d", "descriptor": "Haifa"}
    for _ in range(9):
        deep = {"id": "x", "descriptor": "Group", "values": [deep]}
    bodies = [json.dumps({"facets": [{"facetParameter": "officeLocation", "values": [deep]}]}), json.dumps({"facets": []})]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    assert [(r.i, r.facet, r.ids) for r in boards.workday_home_facets(df, "haifa").collect()] == [(0, "officeLocation", ["d"])]


def ld(*objects):
    return "".join(f'<script type="application/ld+json">{o}</script>' for o in objects)


def test_jsonld_order(ask):
    a, b = '{"@type":"JobPosting","title":"A"}', '{"@type":["X","JobPosting"],"title":"B"}'
    rows = [ld(a), ld(f"[{a},{b}]"), ld(f'{{"@graph":[{a},{{"x":1}},[{b},{a}]]}}'), ld("{bad", a), ld('{"@type":"X"}'),
            ld('{"@type":"JobPosting","title":"line\nbreak"}'), ld(f'[[[[{b}]]]]'), "<p>none</p>", None,
            ld(f'{{"@type":"Org","@graph":{a}}}'), ld("[" * 30 + a + "]" * 30),
            ld('{"@graph":[' * 20 + b + "]}" * 20, a), ld('{"x":"[[[@graph"}', b)]
    out = [r["f"]["title"] if r["f"] else None for r in ask(
        rows, "h string", f=pages.jsonld_fields(pages.jsonld_posting(F.col("h"))))]
    assert out == ["A", "B", "A", "A", None, "line break", "B", None, None, "A", "A", "B", "B"]


def test_jsonld_locations(ask):
    rows = {'{"jobLocation":{"address":{"addressLocality":"Tel Aviv","addressCountry":"IL"}}}': "Tel Aviv, Israel",
            '{"jobLocationType":"TELECOMMUTE","applicantLocationRequirements":{"name":"Iceland"}}': "Remote (Iceland)",
            '{"jobLocationType":"TELECOMMUTE"}': "Remote", '{"jobLocation":"Lod"}': "Lod", '{}': "",
            '{"jobLocation":[{"address":"Main st"},{"address":{"addressCountry":{"name":"France"}}}]}': "Main st | France",
            '{"jobLocation":null,"jobLocationType":"TELECOMMUTE"}': "Remote",
            '{"jobLocation":{"address":{}},"jobLocationType":"TELECOMMUTE"}': ""}
    out = [r["l"] for r in ask(list(rows), "j string", l=pages.jsonld_location(F.parse_json("j")))]
    assert out == list(rows.values())


def test_labels(ask, rules, as_of):
    rows = ["<div>Date:&nbsp;Sep 2, 2026</div><div>Location:&nbsp;</div><div>Bergen, Vestland, NO</div>",
            "<div>מיקום:</div><div>חיפה | משרה מלאה</div><div>פורסם: 20/09/2026</div>",
            "<p>Posted: soon</p><p>posted on: today</p><p>City: A</p><p>City: Lod</p>", "<p>Location:</p>",
            "<p>Location: " + "x" * 85 + "</p>", None]
    out = [r["f"] for r in ask(rows, "h string", f=pages.labeled_fields(F.col("h"), F.lit(as_of).cast("date"), rules))]
    assert [(f["location"], f["posted"]) for f in out] == [
        ("Bergen, Vestland, NO", "Sep 2, 2026"), ("חיפה", "20/09/2026"), ("Lod", "today"), ("", ""), ("", ""), ("", "")]


def test_links_of_a_listing(spark, rules):
    html = ('<a href="/jobs/alpha-1">Kitchen Gardener</a><a href="#x">Kitchen Gardener</a><a href="/jobs/alpha-1#a">Rose Gardener</a>'
            '<a href="https://else.com/jobs/1">Kitchen Gardener</a><a href="https://jobs.lever.co/c/1">Market Gardener</a>'
            '<a href="/jobs/cook-12345">Cook</a><a href="/about">Kitchen Gardener</a><a href="/jobs/x" title="Orchard Keeper"></a>')
    many = "".join(f'<a href="/jobs/{i}">Kitchen Gardener</a>' for i in range(60))
    df = spark.createDataFrame([(1, "https://c.com/careers", html), (2, "https://c.com/", many), (3, "https://c.com/", "<p>"),
                                (4, "https://c.com/", '<a href="/jobs/cook-12345">Cook</a><a href="/jobs/nurse-1234">Nurse</a>')],
                               "page_id int, url string, html string")
    anchors = pages.page_anchors(df)
    out = pages.extract_links(anchors, rules)
    assert [(r.href, r.text) for r in out.where("page_id = 1").orderBy("pos").collect()] == [
        ("https://c.com/jobs/alpha-1", "Rose Gardener"), ("https://jobs.lever.co/c/1", "Market Gardener"),
        ("https://c.com/jobs/x", "Orchard Keeper")]
    assert sorted(int(r.href.split("/")[-1]) for r in out.where("page_id = 2").collect()) == list(range(60))
    status = {r.page_id: r.status for r in pages.page_yield_status(df, anchors, rules).collect()}
    assert (status[1], status[3], status[4]) == ("הצלחה", "חלקי", "הצלחה")


def test_selectors():
    root = parse('<div id="a" class="x y"><p>one<p>two<br>three</div><ul><li>1<li data-k="v:9">2 <b>b</b></ul><script>t</script>')
    assert [n.text("|") for n in root.select("div p")] == ["one", "two|three"]
    assert root.first("#a.x").attrs["class"] == "x y" and root.first("p.x") is None
    assert root.first("li[data-k^=v]").text() == "2 b" and root.first("[data-k*=':9']") is not None
    assert root.text("\n") == "one\ntwo\nthree\n1\n2\nb"


def test_cards(spark):
    adam = ('<div class="job-card-logo"><img alt="לוגו Acme Insurance, join us"></div><article class="job-card" data-job-title=" Kitchen Gardener">'
            '<div class="job-meta"><span><i class="fas fa-map-marker-alt"></i>Gush Dan | HQ</span></div>'
            '<a class="job-detail-link" href="/Jobs/1">x</a><div class="description-text"><p>Do SQL</p><p>More</p></div></article>'
            '<article class="job-card" data-job-title="No link"></article>')
    master = ('<article class="JobItem" id="misra77"><a class="CardHeader">Rose <b>Gardener</b></a><span class="CompanyNameLink">Co</span>'
              '<div class="jobLocation">Lod</div><div class="paddingTop10px"><span class="Gray">yesterday</span></div></article>')
    df = spark.createDataFrame([(1, adam), (2, master)], "i int, html string")
    row = pages.extract_cards(df.where("i = 1"), pages.CARD_BOARDS["adamtotal"]).collect()
    assert [(r.title, r.company, r.location, r.href, r.description) for r in row] == [
        ("Kitchen Gardener", "Acme Insurance", "Gush Dan | HQ", "/Jobs/1", "Do SQL\nMore")]
    row = pages.extract_cards(df.where("i = 2"), pages.CARD_BOARDS["jobmaster"]).collect()
    assert [(r.job_id, r.title, r.company, r.location, r.date_text) for r in row] == [("77", "Rose Gardener", "Co", "Lod", "yesterday")]


def test_posting_from_page(spark, rules, as_of):
    filler = "word " * 60
    plain = (f'<html><body><nav>Menu</nav><h1>Kitchen Gardener</h1><div class="description">{filler}</div>'
             '<div class="share-box">Share</div><p>Location: Lod</p><p>Posted: 2 days ago</p></body></html>')
    structured = ld(json.dumps({"@type": "JobPosting", "title": "Rose Gardener", "description": "<p>Do</p><p>SQL</p>",
                                "hiringOrganization": {"name": "Acme"}, "datePosted": "2026-09-20",
                                "jobLocation": {"address": {"addressLocality": "Haifa"}}})) + "<p>Location: London</p>"
    own = ('<div class="jobHead__text__titleAndCompName">Orchard Keeper</div><a class="CompanyNameLink">Co</a>'
           '<div class="article__jobBody"><p>Body</p><div class="jobsCategories">junk</div></div>'
           '<div class="jobHead__text__moreInfo">פורסם לפני 3 ימים | x</div>')
    # a board page without a title of its own, next to a site name and a heading
    bare = ('<meta property="og:site_name" content="Site"><h1>Heading</h1><div class="article__jobBody">Only a body</div>')
    marked = ("<header>תיאור משרה</header><p>תיאור משרה</p><p>Plant roses</p><p>Water them</p><p>קטגוריה</p><p>Later</p>"
              "<footer>End</footer>")
    df = spark.createDataFrame([(1, "https://c.com/1", plain), (2, "https://c.com/2", structured),
                                (3, "https://www.jobmaster.co.il/3", own), (4, "https://www.jobmaster.co.il/4", bare + structured),
                                (5, "https://www.drushim.co.il/5", marked + structured), (6, "https://www.drushim.co.il/6", structured),
                                (7, "https://www.drushim.co.il/7", marked)], "i int, url string, html string")
    out = {r.i: r for r in pages.posting_from_page(df, F.lit(as_of).cast("date"), rules).collect()}
    assert (out[1].title, out[1].location, out[1].posted_raw, out[1].description) == (
        "Kitchen Gardener", "Lod", "2 days ago", filler.strip())
    assert (out[2].title, out[2].company, out[2].location, out[2].posted_raw, out[2].description) == (
        "Rose Gardener", "Acme", "Haifa", "2026-09-20", "Do\nSQL")
    assert (out[3].title, out[3].company, out[3].description, out[3].posted_raw) == (
        "Orchard Keeper", "Co", "Body", "פורסם לפני 3 ימים")
    assert (out[4].title, out[4].company, out[4].description, out[4].posted_raw, out[4].location) == (
        "", "", "Only a body", "", "London")
    assert (out[5].title, out[5].description) == ("Rose Gardener", "Plant roses\nWater them")
    assert out[6].description == "Do\nSQL"
    assert "Later" in out[7].description


def test_detail_join_counts_the_missing(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "slug string, job_id int")
    details = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "y")], "slug string, job_id int, description string")
    found, missing = payloads.detail_join(rows, details, ["slug", "job_id"])
    assert sorted((r.slug, r.job_id, r.description) for r in found.collect()) == [("a", 1, "x"), ("b", 1, "y")]
    assert [(r.slug, r.missing) for r in missing.collect()] == [("a", 2)]


def test_lever_payload(spark):
    body = json.dumps([{"text": "T", "hostedUrl": "u", "country": "IL", "createdAt": 1790000000000, "id": "1",
                        "categories": {"location": "Tel Aviv, Israel"}, "descriptionPlain": "A",
                        "lists": [{"text": "L", "content": "<li>x</li>"}]}])
    row = payloads.flatten_lever(spark.createDataFrame([("s", body), ("s", '{"ok":false}')], "slug string, body string")).collect()
    assert [(r.location, r.description, r.posted_raw) for r in row] == [("Tel Aviv, Israel", "A\nL\nx", "1790000000000")]


def test_the_latest_detail_is_taken(spark):
    rows = spark.createDataFrame([("s", 1)], "slug string, job_id long")
    details = spark.createDataFrame([("s", 1, "zz old", 1), ("s", 1, "new", 2)], "slug string, job_id long, text string, fetched long")
    found, _ = payloads.detail_join(rows, details, ["slug", "job_id"], "fetched")
    assert [tuple(r) for r in found.collect()] == [("s", 1, "new")]


def test_anchors_as_a_browser_reads_them(spark):
    html = ("<a title='a > b' href=/jobs/one>One</a><!-- <a href='/jobs/two'>Two</a> --><a data-href='/x' HREF = \"/jobs/three\">Three</a>"
            "<script>'<a href=/jobs/four>Four</a>'</script><a name=x>Five</a><a href>Six</a><a x=\"un href='/jobs/seven'>Seven</a>")
    page = spark.createDataFrame([(1, "https://c.com/", html)], "page_id long, url string, html string")
    assert [(r.href, r.text) for r in pages.page_anchors(page).orderBy("pos").collect()] == [
        ("https://c.com/jobs/one", "One"), ("https://c.com/jobs/three", "Three"), ("https://c.com/jobs/seven", "Seven")]


def test_payloads_that_are_no_object_have_no_facet(spark):
    good = '{"facets":[{"facetParameter":"locationCountry","values":[{"id":"x","descriptor":"Haifa"}]}]}'
    df = spark.createDataFrame([(1, "<html>"), (2, None), (3, "[1]"), (4, good)], "k long, body string")
    assert [(r.k, r.ids) for r in boards.workday_home_facets(df, "haifa").collect()] == [(4, ["x"])]


def test_odd_facets_give_nothing(spark):
    odd = ['{"facets":5}', '{"facets":["x", null, 7, {"values":["y"]}]}', '{"facets":[{"facetParameter":"locations","values":[{"id":"a","descriptor":7}]}]}',
           '{"facets":[{"facetParameter":null,"values":[{"id":"a","descriptor":"Haifa"}]}]}', '{"facets":[{"facetParameter":"jobs","id":"a","descriptor":"Haifa"}]}',
           '{"facets":[{"facetParameter":"locations","values":{"id":"a","descriptor":"Haifa"}}]}', '{"facets":null}', "{}"]
    good = ['{"facets":[{"facetParameter":"city-location","values":[{"id":7,"descriptor":"HAIFA"},{"values":[{"id":"b","descriptor":"Haifa bay"}]},{"id":"c"}]}]}',
            '{"facets":[{"facetParameter":"locationsX","id":"1","descriptor":"Haifa"},{"facetParameter":"locations","values":[{"id":"2","descriptor":"Haifa"},'
            '{"facetParameter":"Location_Country","id":"3","descriptor":"haifa"}]}]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(odd + good)], "k long, body string")
    found = boards.workday_home_facets(df, "haifa")
    assert [(r.k, r.facet, r.ids) for r in found.orderBy("k").collect()] == [(8, "city-location", ["7", "b"]), (9, "Location_Country", ["3"])]
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_main_text(spark):
    long, longer = "word " * 50, "more " * 60
    html = [f'<body><div class="description">{long}</div><article><p>{longer}</p><nav>menu</nav><div id="x share-box">no</div></article></body>',
            f'<html><body class="nav"><p>{long}</p><section class="Top MENU_bar">x</section><template>t</template><p>a\n\nb</p></body></html>',
            f'<div role="main">{long}<script>s()</script></div><p>outside</p>', "<p>short</p><form>f</form>", "", None,
            f'<body><main class="menu"><div class="job-posting">{longer}</div>tail</main><footer><article>{longer * 2}</article></footer></body>',
            f'<body><article>{long}</article><article>{long[::-1]}</article></body>', '<body><div class="menuitem">kept</div></body>']
    df = spark.createDataFrame(list(enumerate(html)), "k int, html string")
    got = {r.k: r.main_text for r in pages.main_content_text(df).collect()}
    assert got == {0: longer.strip(), 1: f"{long.strip()}\na\nb", 2: long.strip(), 3: "short", 4: "", 5: "", 6: f"{longer.strip()}\ntail", 7: long.strip(),
                   8: "kept"}


def test_links_of_a_search_page(spark):
    html = ('<ol><li class="b_algo"><h2><a href="https://jobs.lever.co/one/1">1</a></h2><p><a href="https://www.comeet.com/jobs/co/1A.00B?x=1">2</a></p></li>'
            '<li class="b_algo"><a name="none">x</a><a href="https://plain.example.com">3</a></li></ol><a href="https://jobs.lever.co/two">4</a>')
    pages_ = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page int, html string")
    found = boards.search_result_links(pages_).orderBy("page", "pos").collect()
    assert [(r.page, r.pos, r.kind, r.slug) for r in found] == [(1, 0, "lever", "one"), (1, 1, "comeet", "https://www.comeet.com/jobs/co/1A.00B"), (1, 2, None, None)]


def test_plain_pages_give_the_tree_of_the_parser():
    from siftline.sources import nodes

    def shown(node):
        return node if isinstance(node, str) else (node.tag, node.attrs, [shown(c) for c in node.children])

    def whole(html):
        builder = nodes._Builder()
        builder.feed(html)
        builder.close()
        return shown(builder.root)

    plain = ('<ul><li class="a b">one &amp; two<li id="x" id="y">three</ul><br><p a="">4<div><script type="t">if (a) b()</script></div>&lt',
             "no markup", "", "</p></b>end <h2>x\n</h2>")
    for html in plain:
        assert shown(nodes._plain_tree(html)) == whole(html) == shown(nodes.parse(html))
    for html in ("<!-- c --><p>x", "<P>x</P>", "<a href=x>y</a>", "a < b", "<title>a</title>", "<script>a<b</script>", '<a b="1"c="2">', "<br/>", "<p"):
        assert nodes._plain_tree(html) is None
        assert shown(nodes.parse(html)) == whole(html)


def test_pages_are_read_in_small_pieces(monkeypatch):
    """Python holds the texts of PAGES pages at a time, however large a batch is."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from siftline.sources import pages

    class Given:
        columns = ["k", "html"]
        schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("html", T.StringType())])

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["<p>x</p>"] * 999 + [None])], ["k", "html"])
            return list(run(iter([batch])))

    out = pages.map_pages(Given(), pages._strings("text"), lambda root, _: [(root.text(),)] * 2)
    assert max(batch.num_rows for batch in out) <= 2 * pages.PAGES
    assert [k for batch in out for k in batch.column("k").to_pylist()] == [i for i in range(1000) for _ in range(2)]
    assert out[-1].column("text").to_pylist()[-2:] == ["", ""]


def test_large_detail_joins_keep_their_pieces(spark, monkeypatch):
    from siftline.sources import payloads

    monkeypatch.setattr(payloads, "LARGE", 0)
    rows = spark.range(50_000).selectExpr("id % 1000 as slug", "id as job_id")
    details = spark.range(900).selectExpr("id as slug", "'d' as body")
    pieces = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found, missing = payloads.detail_join(rows, details, ["slug"])
        assert found.rdd.getNumPartitions() == pieces
        assert found.count() == 45_000 and missing.agg({"missing": "sum"}).first()[0] == 5_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_an_element_is_walked_once_until_something_is_removed(monkeypatch):
    from siftline.sources import nodes

    walked, walk = [], nodes.Node.walk
    monkeypatch.setattr(nodes.Node, "walk", lambda self: walked.append(self) or walk(self))
    root = nodes.parse('<div class="a"><p><b>x</b></p></div><p id="q"><i>y</i></p>')
    assert [root.first(s).tag for s in ("p", "div.a b", "#q, i", "i")] == ["p", "b", "p", "i"] and len(walked) == 1
    root.first("b").parent.remove()
    assert root.first("b") is None and root.first(".a").children == [] and root.first_text("p") == "y" and len(walked) == 2
