from datetime import date

import pytest
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.operators import audit, cascade, cumulative, dedupe
from siftline.plans import daily_run
from siftline.schemas import POSTINGS_CURRENT, POSTINGS_RAW, conform

TEXT = ("You will raise seedlings, cut hedges, bring in the harvest and look after the soil of a large walled garden. "
        "Needs 2+ years outdoors with pruning and mulching.")
BASE = dict(title="Kitchen Gardener", company="Acme", source="Site", url="https://x.com/1", description=TEXT, location="Tel Aviv",
            posted_raw="2026-09-20", updated_raw="", job_id="", experience_hint="", home_context=False, listing_url="https://x.com/",
            industry="")


def raw(spark, *changes):
    rows = [tuple({**BASE, **change, "ord": i}[f.name] for f in POSTINGS_RAW) for i, change in enumerate(changes)]
    return spark.createDataFrame(rows, POSTINGS_RAW)


def empty(spark):
    return spark.createDataFrame([], POSTINGS_CURRENT)


def run(spark, rules, stored, *changes, as_of="2026-09-24"):
    return daily_run.run(raw(spark, *changes), stored, F.lit(as_of).cast("date"), rules)


def kept_state(result):
    return result.current.sparkSession.createDataFrame(conform(result.current, POSTINGS_CURRENT).collect(), POSTINGS_CURRENT)


def outcomes(spark, rules, *changes):
    out = cascade.evaluate(raw(spark, *changes), F.lit("2026-09-24").cast("date"), rules)
    return [r.outcome for r in out.orderBy("ord").collect()]


def test_every_stage_gives_its_reason(spark, rules):
    assert outcomes(
        spark, rules, {}, {"title": "Cook"}, {"title": "Tree Feller"}, {"description": "Too short"}, {"description": None},
        {"description": TEXT.replace("pruning and mulching", "spreadsheets")}, {"location": "Haifa"}, {"location": "Berlin, Germany"},
        {"title": "Kitchen Gardener (London)"}, {"posted_raw": "2026-09-03"}, {"posted_raw": "2026-09-04"}, {"posted_raw": ""},
        {"posted_raw": "2026-08-01", "updated_raw": "2026-09-20"}, {"title": "Irrigation Fitter / Market Gardener", "description":
            "Lay asphalt and concrete with a crane, a scaffold and diesel excavators by the wall, plus pruning, all day long."},
    ) == [L.ACCEPTED, L.TITLE_NOT_RELEVANT, L.TITLE_NOT_RELEVANT, L.NO_DESCRIPTION, L.NO_DESCRIPTION, L.NO_KEYWORD,
          L.PLACE_PREFIX + L.REGION_NORTH, L.PLACE_PREFIX + L.PLACE_ABROAD, L.PLACE_PREFIX + L.PLACE_TITLE_ABROAD, L.TOO_OLD,
          L.ACCEPTED, L.ACCEPTED, L.ACCEPTED, L.ESSENCE_COMBINED_NO]


def test_accepted_row(spark, rules):
    out = cascade.evaluate(raw(spark, {"company": " ", "posted_raw": ""}), F.lit("2026-09-24").cast("date"), rules)
    job = cascade.accepted_jobs(out).first()
    assert job.company == L.UNKNOWN_COMPANY and job.date_iso is None and job.date_display == L.UNKNOWN_DATE
    assert job.experience == "2+ years outdoors" and job.location == "Tel Aviv"
    assert job.reason == L.ESSENCE_LISTED_OK + "; מילות מפתח בתיאור: Mulching, Pruning" + L.DATE_UNKNOWN_SUFFIX
    assert job.key == "https://x.com/1" and job.alt_key.endswith("|kitchen gardener|tel aviv")


def test_filter_on_outcome_does_not_repeat_the_work(spark, rules):
    out = cascade.accepted_jobs(cascade.evaluate(raw(spark, {}), F.lit("2026-09-24").cast("date"), rules))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") <= 10 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_three_days(spark, rules):
    first = run(spark, rules, empty(spark), {"url": "https://x.com/a"}, {"url": "https://x.com/b", "title": "Rose Gardener",
                                                                       "posted_raw": ""})
    assert first.new_jobs.count() == 2 and first.removed.first().removed == 0
    state = kept_state(first)
    # same address with tracking parameters: continued, not new
    second = run(spark, rules, state, {"url": "https://x.com/a?utm_source=z", "posted_raw": "2026-09-23"}, as_of="2026-09-25")
    assert second.new_jobs.count() == 0
    row = second.current.where("key = 'https://x.com/a'").first()
    assert (row.first_seen, row.last_seen, row.date_iso) == (date(2026, 9, 24), date(2026, 9, 25), date(2026, 9, 23))
    # the dated row expires, the undated one stays
    later = run(spark, rules, kept_state(second), as_of="2026-10-24")
    assert later.removed.first().removed == 1
    assert [r.date_iso for r in later.current.collect()] == [None]
    # an old date found later removes the undated row
    gone = run(spark, rules, kept_state(later), {"url": "https://x.com/b", "title": "Rose Gardener", "posted_raw": "2026-08-01"})
    assert gone.removed.first().removed == 1 and gone.current.count() == 0


def test_low_priority_copy_is_not_new(spark, rules):
    first = run(spark, rules, empty(spark), {"company": "Port", "location": "Holon, Israel"})
    copy = {"company": "Port", "source": "Secret Tel Aviv", "url": "https://s.com/9", "location": "Netanya/ Holon"}
    assert run(spark, rules, kept_state(first), copy).new_jobs.count() == 0
    assert run(spark, rules, kept_state(first), {**copy, "source": "Other"}).new_jobs.count() == 1


def test_in_run_duplicates_and_counts(spark, rules):
    result = run(spark, rules, empty(spark), {}, {"url": "https://x.com/1?ref=2"}, {"url": "https://y.com/5"}, {"title": "Cook"})
    assert {r.reason: r.n for r in result.reasons.collect()} == {L.ACCEPTED: 3, L.DUPLICATE: 2, L.TITLE_NOT_RELEVANT: 1}
    statuses = spark.createDataFrame([("https://x.com/", "A", "m", L.OK, "", 0)], "url string, site string, method string, "
                                                                                  "status string, error string, count long")
    assert audit.status_counts(statuses, result.kept).first()["count"] == 1


def current(spark, *rows):
    base = dict(title="T", company="C", source="S", location="Lod", experience="", reason="r", url="u", date_display="",
                date_iso=None, key="k", alt_key="a", first_seen=date(2026, 9, 1), last_seen=date(2026, 9, 1), company_type="", ord=0)
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in POSTINGS_CURRENT) for r in rows], POSTINGS_CURRENT)


def test_retractions(spark):
    table = current(spark, *[dict(key=k, date_iso=d) for k, d in (
        ("always", date(2026, 9, 20)), ("undated", None), ("older", date(2026, 9, 20)), ("same", date(2026, 9, 10)),
        ("two", date(2026, 9, 20)), ("other", None))])
    gone = spark.createDataFrame([("always", None, None), ("undated", None, date(2026, 8, 1)), ("older", None, date(2026, 9, 19)),
                                  ("same", None, date(2026, 9, 10)), ("two", None, date(2026, 9, 1)), ("two", None, None)],
                                 "key string, alt_key string, seen_date date")
    assert sorted(r.key for r in cumulative.retract_join(table, gone).collect()) == ["older", "other"]


def test_two_postings_continue_one_row(spark, rules):
    stored = current(spark, dict(key="k1", alt_key="a1", location=L.UNKNOWN_PLACE, title="T", date_iso=date(2026, 9, 1)))
    jobs = spark.createDataFrame(
        [("T", "C", "S", L.UNKNOWN_PLACE, "", "r", "u", "d", date(2026, 9, 10), "k1", "a9", "c|t", False, "", 1),
         ("T", "C", "S", "Haifa", "3 years", "r", "u", "d", date(2026, 9, 5), "k9", "a1", "c|t", False, "", 2)],
        "title string, company string, source string, location string, experience string, reason string, url string, "
        "date_display string, date_iso date, key string, alt_key string, company_title string, is_low_priority boolean, "
        "listing_url string, ord long")
    row = cumulative.upsert_cumulative(stored, jobs, F.lit("2026-09-24").cast("date"), rules).collect()
    assert len(row) == 1
    assert (row[0].date_iso, row[0].date_display, row[0].location, row[0].experience) == (
        date(2026, 9, 10), "10/09/2026", "Haifa", "3 years")


def test_report_order(spark):
    rows = [dict(key="retail", company_type=L.RETAIL, date_iso=date(2026, 9, 23)), dict(key="h1", company_type=L.HITECH,
            date_iso=date(2026, 9, 10)), dict(key="h2", company_type=L.HITECH, date_iso=date(2026, 9, 22)),
            dict(key="h3", company_type=L.HITECH), dict(key="?", company_type="new kind", date_iso=date(2026, 9, 23)),
            dict(key="agency", company_type=L.AGENCY, date_iso=date(2026, 9, 24))]
    assert [r.key for r in cumulative.report_order(current(spark, *rows)).collect()] == ["h2", "h1", "h3", "retail", "?", "agency"]


def test_types_of_stored_rows(spark, rules):
    stored = current(spark, dict(key="1", company="Discount Bank"), dict(key="2", company="Zork", company_type=L.MEDIA),
                     dict(key="3", company="Acme"))
    types = spark.createDataFrame([("acme", L.RETAIL)], "company_key string, company_type string")
    out = {r.key: r.company_type for r in cumulative.apply_company_types(stored, types, rules).collect()}
    assert out == {"1": L.BANKS, "2": L.MEDIA, "3": L.RETAIL}


def test_strongest_signal_of_a_company(spark, rules):
    rows = raw(spark, {"company": "Zork", "industry": ""}, {"company": "ZORK ltd", "industry": "Banking"},
               {"company": "zork", "industry": "Retail"}).withColumns(
        {"job_company": F.col("company"), "is_low_priority": F.lit(False)})
    out = cumulative.strongest_company_type(rows, rules).collect()
    assert [(r.company_key, r.company_type) for r in out] == [("zork", L.BANKS)]


def test_dedupe_needs_unique_order(spark, rules):
    jobs = cascade.accepted_jobs(cascade.evaluate(raw(spark, {}, {}), F.lit("2026-09-24").cast("date"), rules))
    assert [r.ord for r in dedupe.greedy_dedupe(jobs).collect()] == [0]


def test_unique_sites_and_notes(spark):
    statuses = spark.createDataFrame([
        ("A", L.OK, "", 1), ("a", L.OK, "", 0), ("B", L.FAILED, "x", 2), ("Bing x", L.OK, "", 3), ("C", L.PARTIAL, L.NOT_SCANNED, 4),
        ("D", L.PARTIAL, "n", 5)], "site string, status string, error string, ord long")
    assert [r.site for r in audit.unique_sites(statuses).collect()] == ["a", "D"]
    links = spark.createDataFrame([("1", None, None, None), ("2", L.FAILED, "HTTP 500", 2), ("3", None, None, None),
                                   ("4", L.FAILED, "HTTP 500", 2), ("5", L.FAILED, "HTTP 500", None)],
                                  "url string, failure string, message string, failed_at long")
    notes = spark.createDataFrame([("1", "n2", 5), ("1", "n1", 1), ("1", "n2", 2), ("2", "early", 1), ("4", "early", 1),
                                   ("4", "after", 3), ("5", "any", 1)], "url string, note string, ord long")
    out = {r.url: (r.status, r.error) for r in audit.status_notes(links, notes).collect()}
    assert out == {"1": (L.PARTIAL, "n1; n2"), "2": (L.FAILED, "HTTP 500"), "3": (L.OK, ""),
                   "4": (L.FAILED, "early; after"), "5": (L.FAILED, "HTTP 500")}


def test_history_tail(spark):
    runs = spark.createDataFrame([(date(2026, 1, 1 + i), i) for i in range(9)], "run_date date, run_id int")
    assert [r.run_id for r in audit.history_tail(runs, 3).collect()] == [6, 7, 8]


@pytest.mark.parametrize("bad", ["nope"])
def test_union_sources_reports_a_broken_one(spark, bad):
    from siftline.sources.fetches import union_sources

    good = raw(spark, {})
    rows, broken = union_sources({"good": lambda: good, bad: lambda: spark.read.parquet("/no/such/path")}, good)
    assert rows.count() == 1
    assert [(r.site, r.status) for r in broken.collect()] == [(bad, L.FAILED)]


def test_sources_without_an_order_stand_as_in_their_files(spark, rules, tmp_path):
    from siftline.sources.fetches import union_sources

    for name, n in (("b", 3), ("a", 2)):
        raw(spark, *[{"job_id": f"{name}{i}", "url": f"https://{name}.com/{i % 2}"} for i in range(n)]).drop("ord").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / name))
    folders = [str(tmp_path / name) for name in "ab"]
    second = raw(spark, {"url": "https://other.example.com/1", "job_id": "c0"})

    def orders(split):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows, broken = union_sources({"files": lambda: spark.read.parquet(*folders), "table": lambda: second,
                                      "no order": lambda: second.drop("ord")}, second)
        found = {r.job_id: r.ord for r in rows.collect()}
        assert [r.site for r in broken.collect()] == ["no order"]
        return found, rows

    try:
        found, rows = orders("1k")
        again, _ = orders("128m")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == again and sorted(found, key=found.get) == ["a0", "a1", "b0", "b1", "b2", "c0"]
    jobs = cascade.accepted_jobs(cascade.evaluate(rows, F.lit("2026-09-24").cast("date"), rules))
    assert dedupe.greedy_dedupe(jobs).count() == 1
