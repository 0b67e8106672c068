"""Landed files to postings: every source, one order, files that can't be read."""

import json

import pytest
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.sources import landing, quarantine



def day():
    return F.lit("2026-09-24").cast("date")


T = "Kitchen Gardener"


def ld(**fields):
    return f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", **fields})}</script>'


ROWS = [
    ("greenhouse", "list", "blue-co", "", "u1", json.dumps({"jobs": [{"id": 1, "title": "Cook", "absolute_url": "https://b.com/0"}, {
        "id": 2, "title": T, "absolute_url": "https://b.com/1", "location": {"name": "Lod"}, "content": "&lt;p&gt;Do it&lt;/p&gt;"}]})),
    ("greenhouse", "board", "blue-co", "", "", json.dumps({"name": " Blue Co Ltd "})),
    ("greenhouse", "board", "blue-co", "", "", "{broken"),
    ("greenhouse", "list", "Blue-Co", "", "u1", json.dumps({"jobs": [{"id": 3, "title": T, "absolute_url": "https://b.com/3"}]})),  # read again
    ("greenhouse", "list", "red_co", "", "u2", json.dumps({"jobs": [{"id": 4, "title": T, "absolute_url": "https://r.com/4"}]})),
    ("workable", "list", "w", "", "", json.dumps({"results": [{"title": T, "shortcode": "A", "location": {"city": "Tel Aviv"}}, {
        "title": T, "shortcode": "B", "location": {"city": "Berlin", "country": "Germany"}}, {"title": T, "shortcode": "C"}]})),
    ("workable", "detail", "w", "A", "", json.dumps({"description": "<p>Dig</p>"})),
    ("smartrecruiters", "list", "s", "", "", json.dumps({"content": [{"id": "7", "name": T, "company": {"name": "Smart"}, "location": {"city": "Tel Aviv"}}]})),
    ("smartrecruiters", "detail", "s", "7", "", json.dumps({"jobAd": {"sections": {"jobDescription": {"text": "Rake"}}}})),
    ("comeet", "list", "https://www.comeet.com/jobs/co/1A.00B", "", "", 'COMPANY_DATA = {"name": "Comp"} COMPANY_POSITIONS_DATA = ' + json.dumps(
        [{"name": T, "uid": "x", "url_active_page": "https://c.com/x", "details": [{"name": "d", "value": "Plant"}]}]) + ";"),
    ("comeet", "list", "1a.00b|TOKEN", "", "", json.dumps([{"name": T, "uid": "y", "url_active_page": "https://c.com/y"}])),  # the same company
    ("workday", "list", "https://acme.wd3.myworkdayjobs.com/Ext", "", "", json.dumps({"jobPostings": [{"title": T, "externalPath": "/job/1"}]})),
    ("workday", "detail", "https://acme.wd3.myworkdayjobs.com/Ext", "/job/1", "", json.dumps({"jobPostingInfo": {"jobDescription": "Mow"}})),
    ("linkedin", "list", "https://www.linkedin.com/s", "", "p1", f'<li><div data-entity-urn="urn:li:job:5"><h3>{T}</h3><h4>Co</h4>'
     '<time datetime="">x</time></div></li><li><div data-entity-urn="urn:li:job:6"><h3>Rose Gardener</h3></div></li>'),
    ("linkedin", "detail", "", "5", "", '<div class="description__text">Weed</div><span class="posted-time-ago__text">3 days ago</span>'),
    ("drushim", "list", "https://www.drushim.co.il/q", "", "", json.dumps({"ResultList": [{"Code": "9", "JobInfo": {"Link": "/job/9/", "Date": "2026-09-20"},
     "JobContent": {"Name": T, "Addresses": [{"City": "לוד"}], "Experience": {"NameInHebrew": "3 שנים"}}, "Company": {"NameInHebrew": "חברה"}}]})),
    ("drushim", "detail", "", "9", "https://www.drushim.co.il/job/9/", "<p>תיאור משרה</p><p>Hoe</p><p>קטגוריה</p><p>x</p>" + ld(title="x")),
    ("jobmaster", "list", "https://www.jobmaster.co.il/q", "", "", f'<article class="JobItem" id="misra77"><a class="CardHeader">{T}</a></article>'),
    ("jobmaster", "detail", "", "77", "https://www.jobmaster.co.il/jobs/checknum.asp?key=77", '<div class="article__jobBody">Sow</div>'),
    ("alljobs", "list", "https://www.alljobs.co.il/q", "", "", "".join(
        f'<div class="{c}" id="job-box-container{i}"><div class="job-content-top-title"><a href="/x/UploadSingle.aspx?JobID={i}">{T}</a></div></div>'
        for i, c in ((11, "open-board"), (12, "organic-board")))),
    ("alljobs", "detail", "", "11", "https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID=11", ld(
        title="Rose Gardener", description="Reap", hiringOrganization={"name": "All"}, datePosted="2026-09-21")),
    ("indeed", "list", "https://il.indeed.com/q", "", "", 'window.mosaic.providerData["mosaic-provider-jobcards"] = ' + json.dumps(
        {"metaData": {"mosaicProviderJobCardsModel": {"results": [{"title": T, "jobkey": "k", "company": "In"}]}}}) + ";"),
    ("indeed", "detail", "", "k", "https://il.indeed.com/viewjob?jk=k", ld(title=T, description="Hay")),
    ("secret", "list", "https://www.secrettelaviv.com/jobs/", "", "", '<div class="wpjb-grid-row"><div class="wpjb-col-title"><a href="https://s.com/j/1/">'
     f'{T}</a></div></div>'),
    ("secret", "detail", "", "https://s.com/j/1/", "https://s.com/j/1/", ld(title="x", description="Bale", hiringOrganization={"name": "Sec"})),
    ("adamtotal", "list", "https://career.adamtotal.co.il/c", "", "https://career.adamtotal.co.il/c", f'<article class="job-card" data-job-title="{T}">'
     '<a class="job-detail-link" href="/Jobs/1">x</a><div class="description-text">Prune</div></article>'),
    ("page", "page", "https://firm.co.il/careers", T, "https://firm.co.il/jobs/1", ld(description="Graft", hiringOrganization={"name": "Firm"})),
    ("page", "page", "https://firm.co.il/careers", T, "https://firm.co.il/jobs/2", "<html></html>"),
    ("page", "page", "https://firm.co.il/careers", T, "https://r.com/4?utm_source=x", ld(description="The same address as a board's")),
    ("unheard", "list", "", "", "", "x"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed"))
    for at in range(0, len(ROWS), 7):
        spark.createDataFrame(ROWS[at:at + 7], "source string, part string, slug string, item string, url string, body string").coalesce(
            1).write.mode("append").parquet(path)
    return path


def read(spark, folder, rules):
    rows, bad = landing.read_landed(spark, folder)
    hints = spark.createDataFrame([("greenhouse", "RED_CO", "Red"), ("lever", "blue-co", "No")], "kind string, slug string, company string")
    return landing.landed_postings(rows, day(), rules, hints, bad)


def test_every_source(spark, folder, rules):
    found = read(spark, folder, rules)
    got = {(r.source, r.url): r for r in found.postings.collect()}
    short = {key: (r.company, r.description, r.listing_url, r.home_context) for key, r in got.items()}
    assert short == {
        ("Blue Co Ltd", "https://b.com/1"): ("Blue Co Ltd", "Do it", "https://job-boards.greenhouse.io/blue-co", False),
        ("W", "https://apply.workable.com/w/j/A/"): ("W", "Dig", "https://apply.workable.com/w/", False),
        ("Smart", "https://jobs.smartrecruiters.com/s/7"): ("Smart", "Rake\n\n", "https://careers.smartrecruiters.com/s", False),
        ("Comp", "https://c.com/x"): ("Comp", "Plant", "https://www.comeet.com/jobs/co/1A.00B", False),
        ("Acme", "https://acme.wd3.myworkdayjobs.com/Ext/job/1"): ("Acme", "Mow", "https://acme.wd3.myworkdayjobs.com/Ext", False),
        ("LinkedIn", "https://www.linkedin.com/jobs/view/5"): ("Co", "Weed", "https://www.linkedin.com/s", True),
        ("Drushim", "https://www.drushim.co.il/job/9/"): ("חברה", "Hoe", "https://www.drushim.co.il/q", True),
        ("JobMaster", "https://www.jobmaster.co.il/jobs/checknum.asp?key=77"): ("", "Sow", "https://www.jobmaster.co.il/q", True),
        ("AllJobs", "https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID=11"): ("All", "Reap", "https://www.alljobs.co.il/q", True),
        ("Indeed", "https://il.indeed.com/viewjob?jk=k"): ("In", "Hay", "https://il.indeed.com/q", True),
        ("Secret Tel Aviv", "https://s.com/j/1/"): ("Sec", "Bale", "https://www.secrettelaviv.com/jobs/", True),
        ("adamtotal.co.il", "https://career.adamtotal.co.il/Jobs/1"): ("adamtotal.co.il", "Prune", "https://career.adamtotal.co.il/c", True),
        ("firm.co.il", "https://firm.co.il/jobs/1"): ("Firm", "Graft", "https://firm.co.il/careers", True),
        # the page came first in the order of the run, so the board's posting at its address is not read
        ("firm.co.il", "https://r.com/4?utm_source=x"): ("", "The same address as a board's", "https://firm.co.il/careers", True)}
    assert got["LinkedIn", "https://www.linkedin.com/jobs/view/5"].posted_raw == "3 days ago"
    alljobs = got["AllJobs", "https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID=11"]
    assert (alljobs.title, alljobs.posted_raw, alljobs.updated_raw) == ("Rose Gardener", "", "2026-09-21")
    assert got["Drushim", "https://www.drushim.co.il/job/9/"].experience_hint == "3 שנים"
    assert [r.url for r in found.subscriber_urls.collect()] == ["https://www.alljobs.co.il/Search/UploadSingle.aspx?JobID=12"]
    assert {r.url: r.error for r in found.statuses.collect() if r.status == L.PARTIAL} == {
        "https://apply.workable.com/w/": f"1 {L.PAGES_NOT_LOADED}", "https://www.linkedin.com/s": f"1 {L.PAGES_NOT_LOADED}",
        "https://firm.co.il/careers": f"1 {L.PAGE_WITHOUT_TEXT}"}


def test_the_order_is_the_same_for_any_number_of_partitions(spark, folder, rules):
    runs = []
    try:
        for split, shuffles in (("1k", "3"), ("128m", "7")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            spark.conf.set("spark.sql.adaptive.enabled", str(split == "1k").lower())
            runs.append({(r.url, r.ord) for r in read(spark, folder, rules).postings.collect()})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert runs[0] == runs[1] and len({o for _, o in runs[0]}) == len(runs[0])
    order = [u for u, _ in sorted(runs[0], key=lambda r: r[1])]
    assert set(order[:2]) == {"https://firm.co.il/jobs/1", "https://r.com/4?utm_source=x"}
    assert order[2] == "https://www.linkedin.com/jobs/view/5" and order[-1] == "https://s.com/j/1/"


def test_a_cut_off_file_costs_itself_only(spark, folder, rules, tmp_path):
    import shutil

    copy = tmp_path / "landed"
    shutil.copytree(folder, copy)
    spark.createDataFrame([], spark.read.parquet(folder).schema).coalesce(1).write.mode("append").parquet(str(copy))  # empty, but whole
    files = sorted(p for p in copy.glob("*.parquet"))
    whole = max(files, key=lambda p: p.stat().st_size)
    for crc in copy.glob(".*.crc"):
        crc.unlink()
    whole.write_bytes(whole.read_bytes()[:-100])
    rows, bad = landing.read_landed(spark, str(copy))
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect()] == [(whole.name, "no Parquet footer")]
    assert rows.count() in (len(ROWS) - 7, len(ROWS) - len(ROWS) % 7)
    failed = [r for r in landing.landed_postings(rows, day(), rules, None, bad).statuses.collect() if r.status == L.FAILED]
    assert len(failed) == 1 and failed[0].url.endswith(whole.name)


def test_broken_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1, "t": "x"}\n{"k": 2, "t": \n\n{"k": "no number"}\n{"k": 3, "more": [1]}\n')
    rows, bad = quarantine.sound_json(spark, str(tmp_path), spark.createDataFrame([], "k long, t string").schema)
    assert [(r.k, r.t) for r in rows.orderBy("k").collect()] == [(1, "x"), (3, None)]
    assert sorted(r.record for r in bad.collect()) == ['{"k": "no number"}', '{"k": 2, "t": ']
    assert [(r.status, r.error) for r in quarantine.failed_files(bad, "s").collect()] == [(L.FAILED, "no JSON of the schema: 2")]
