import pytest
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.functions import companies, dates, places, urls


def decide(ask, rules, rows):
    rows = [(*r, *("", "", False)[len(r) - 1:]) for r in rows]
    return [r["p"] for r in ask(rows, "l string, d string, u string, c boolean", p=places.classify_location(
        F.col("l"), F.col("d"), F.col("u"), F.col("c"), rules))]


def test_home(ask, rules):
    names = ["Tel Aviv-Yafo", "Ramat Gan / Givatayim", "Israel", "Remote, Israel", "Holon, IL", "קרית אונו",
             "Tel Aviv | Jerusalem", "צפון תל אביב", "some place in עברית"]
    assert [p["decision"] for p in decide(ask, rules, [(n,) for n in names])] == ["israel"] * len(names)


def test_excluded_regions(ask, rules):
    out = decide(ask, rules, [("Haifa",), ("North",), ("דרום",), ("קרית אתא",), ("Jerusalem; Rehovot",)])
    assert [(p["decision"], p["note"]) for p in out] == [
        ("excluded", L.REGION_NORTH), ("excluded", L.REGION_NORTH), ("excluded", L.REGION_SOUTH),
        ("excluded", L.REGION_NORTH), ("excluded", L.REGION_JERUSALEM)]


def test_abroad(ask, rules):
    out = decide(ask, rules, [("Berlin, Germany",), ("Austin, TX",), ("Leeds, GB", "offices in Tel Aviv"), ("Remote (France)",),
                              ("Gotham",)])
    assert [p["decision"] for p in out] == ["foreign"] * 5
    assert out[-1]["note"] == L.PLACE_NOT_HOME and out[0]["note"] == L.PLACE_ABROAD


def test_context(ask, rules):
    out = decide(ask, rules, [("",), ("", "", "", True), ("Remote", "our Tel Aviv team"), ("", "", "https://a.co.il/x"),
                              ("", "join us in Paris"), ("Gotham", "", "", True), ("Hybrid",), (None, "x " * 700 + "paris")])
    assert [(p["decision"], p["display"]) for p in out] == [
        ("unknown", L.UNKNOWN_PLACE), ("israel", "ישראל"), ("israel", "ישראל (Remote)"), ("israel", "ישראל"),
        ("foreign", ""), ("israel", "Gotham"), ("unknown", L.UNKNOWN_PLACE), ("foreign", "")]


def test_title_abroad(ask, rules):
    rows = ["Analyst (Oslo)", "Analyst (Tel Aviv)", "Analyst Tel Aviv or London", "Analyst, relocation", "Analyst"]
    out = [r["x"] for r in ask(rows, "t string", x=places.title_says_abroad(F.col("t"), rules))]
    assert out == [True, False, True, True, False]


def test_location_key(ask, rules):
    rows = ["Tel Aviv-Yafo, Tel Aviv District, Israel", "Tel Aviv", "Gotham City", ""]
    assert [r["k"] for r in ask(rows, "l string", k=places.location_key(F.col("l"), rules))] == [
        "tel aviv", "tel aviv", "gotham city", ""]


DATES = {
    "2026-09-20": "2026-09-20", "2026-09-20T23:30:00Z": "2026-09-21", "2026-09-20T01:30:00.5-05:00": "2026-09-20",
    "2026-01-20T22:30:00+0000": "2026-01-21", "2026-07-20T20:59:00Z": "2026-07-20", "2026-07-20T21:00:00Z": "2026-07-21",
    "posted 2026-09-01!": "2026-09-01", "2026-02-30": None, "2026-13-01 and 3 days ago": None, "31.2.2026": None,
    "20/09/2026": "2026-09-20", "1.9.26": "2026-09-01", "Sep 17, 2026": "2026-09-17", "17th September 2026": "2026-09-17",
    "september 17 2026": "2026-09-17", "Sept 17, 2026": None, "Today": "2026-09-24", "Just posted": "2026-09-24",
    "אתמול": "2026-09-23", "yesterday": "2026-09-23", "30+ days ago": "2026-08-25", "2 weeks ago": "2026-09-10",
    "5 hrs ago": "2026-09-24", "לפני 3 ימים": "2026-09-21", "5 ימים": "2026-09-19", "לפני שבועיים": "2026-09-10",
    "a month ago": "2026-08-25", "one day ago": "2026-09-23", "1790000000000": "2026-09-21", "1790000000": "2026-09-21",
    "soon": None, "": None, "2026-09-20 25:00:00Z": "2026-09-20", "99999999999 days ago": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, ask, rules, as_of, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        out = ask(list(DATES), "s string", d=dates.parse_posting_date(F.col("s"), F.lit(as_of).cast("date"), rules).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {k: r["d"] for k, r in zip(DATES, out)} == DATES


def test_relevant_and_fresh(ask, as_of):
    today = F.lit(as_of).cast("date")
    rows = [("2026-08-01", "2026-09-22"), ("2026-09-04", None), ("2026-09-03", None), (None, None), ("2027-01-01", None)]
    d = dates.relevant_date(F.col("p").cast("date"), F.col("u").cast("date"), today)
    out = ask(rows, "p string, u string", d=d.cast("string"), f=dates.freshness(d, today, 20), s=dates.date_display(d))
    assert [(r["d"], r["f"]) for r in out] == [("2026-09-22", True), ("2026-09-04", True), ("2026-09-03", False),
                                               (None, None), ("2026-09-24", True)]
    assert out[3]["s"] == L.UNKNOWN_DATE and out[1]["s"] == "04/09/2026"


def test_canonical_url(ask):
    rows = {"http://WWW.Example.com/a/b/?utm_source=1&b=2&a=1%20x&refid=1&blank=#f": "https://example.com/a/b?a=1+x&b=2",
            "https://a.com": "https://a.com/", "https://a.com/p;x=1?q=%D7%90&z=": "https://a.com/p?q=%D7%90",
            "https://il.linkedin.com/jobs/view/foo-1234567890?x=1": "https://www.linkedin.com/jobs/view/1234567890",
            "https://a.com/x?reference=1&sourcecode=2&k=~*": "https://a.com/x?k=~%2A",
            " https://a.com/x y?q=100% ": "https://a.com/x y?q=100%25", "https://[a/x": "https://[a/x"}
    out = [r["c"] for r in ask(list(rows), "u string", c=urls.canonical_url(F.col("u")))]
    assert out == list(rows.values())


def test_resolve(ask):
    base = "https://x.com/a/b/c.html?q=1"
    rows = {"/j": "https://x.com/j", "d": "https://x.com/a/b/d", "../d?x=1#f": "https://x.com/a/d?x=1", "?z": "https://x.com/a/b/c.html?z",
            "#f": "https://x.com/a/b/c.html?q=1", "//y.com/z": "https://y.com/z", "http://y.com": "http://y.com",
            "./e/": "https://x.com/a/b/e/", "../../../up": "https://x.com/up", "mailto:a@b.c": "mailto:a@b.c"}
    out = [r["c"] for r in ask(list(rows), "h string", c=urls.resolve_url(F.lit(base), F.col("h")))]
    assert out == list(rows.values())


def test_sectors(ask, rules):
    rows = [("Elm Insurance", "", "", ""), ("Harbour Bank", "", "", ""), ("", "", "", ""), ("Moss Agency", "", "", ""),
            ("Zork", "Banking", "", ""), ("Zork", "Hospitality", "", ""), ("Zork", "", "https://jobs.lever.co/z", ""),
            ("Zork", "", "", "an open source prototype"), ("Zork", "", "", "we sell"), ("Quiet Co", "", "", "")]
    out = [(r["s"]["type"], r["s"]["strength"]) for r in ask(rows, "c string, i string, l string, d string", s=companies.company_sector(
        F.col("c"), F.col("i"), F.col("l"), F.lit(""), F.col("d"), rules))]
    assert out == [(L.FINANCE, "name"), (L.BANKS, "name"), (L.AGENCY, "hidden"), (L.AGENCY, "hidden"), (L.BANKS, "industry"),
                   (L.OTHER, "none"), (L.HITECH, "ats"), (L.HITECH, "description"), (L.OTHER, "none"), (L.MEDIA, "override")]


def test_company_key(ask, rules):
    rows = ["Acme Ltd.", "ACME group", "Acme (Group), Inc", "אקמה בע\"מ"]
    assert [r["k"] for r in ask(rows, "c string", k=companies.company_key(F.col("c"), rules))] == ["acme", "acme", "acme", "אקמה"]
