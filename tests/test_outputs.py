from datetime import date, datetime
from datetime import date as date_of

import pytest
from pyspark.sql import functions as F

from siftline import labels as L
from siftline.operators import discovery, report, vocabulary
from siftline.plans import daily_run
from siftline.schemas import POSTINGS_CURRENT, VOCAB, conform
from siftline.sources import fetches, state
from siftline.streaming.stream import stream_upsert, stream_visit_once
from siftline.vocab import rules_from_table

from .test_cumulative import current, raw


def test_state_versions(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert state.read_state(spark, folder).count() == 0 and state.current_version(spark, folder) is None and state.history(spark, folder).count() == 0
    state.write_state(current(spark, {"key": "a"}), folder, "2026-09-23", 0)
    first = state.current_version(spark, folder)
    # the version being read is never overwritten
    state.write_state(state.read_state(spark, folder).unionByName(current(spark, {"key": "b"})), folder, "2026-09-24", 1)
    assert sorted(r.key for r in state.read_state(spark, folder).collect()) == ["a", "b"]
    assert state.read_state(spark, folder, version=first).count() == 1
    assert state.current_version(spark, folder)["batch_id"] == 1
    assert [(r.run_id, str(r.run_date), r.batch_id, r.raw) for r in state.history(spark, folder).orderBy("run_id").collect()] == [
        (0, "2026-09-23", 0, None), (1, "2026-09-24", 1, None)]
    assert state.already_done(spark, folder, "2026-09-24") and not state.already_done(spark, folder, "2026-09-25")


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = str(tmp_path / "state")
    keys = [f"k{i}" for i in range(40)]
    state.write_state(current(spark, *[{"key": k} for k in keys]), folder, "2026-09-23", buckets=8)
    first = state.current_version(spark, folder)
    touched = state.buckets_of([spark.createDataFrame([("k7",)], "key string")], 8)
    assert len(touched) == 1
    rows = state.read_state(spark, folder, touched, first).where("key <> 'k7'").unionByName(current(spark, {"key": "k7", "title": "new"}))
    state.write_state(rows, folder, "2026-09-24", base=first, touched=touched)
    second = state.current_version(spark, folder)
    assert second["written"] == [str(touched[0])]
    assert {b for b in first["paths"] if first["paths"][b] != second["paths"][b]} == {str(touched[0])}
    assert sorted((r.key, r.title) for r in state.read_state(spark, folder).collect()) == sorted((k, "new" if k == "k7" else "T") for k in keys)
    # a bucket that becomes empty goes
    state.write_state(rows.limit(0), folder, "2026-09-25", base=second, touched=touched)
    assert str(touched[0]) not in state.current_version(spark, folder)["paths"]


def test_the_second_of_two_writers_fails_and_keeps_its_rows(spark, tmp_path):
    folder = str(tmp_path / "state")
    state.write_state(current(spark, {"key": "a"}), folder, "2026-09-23")
    base = state.current_version(spark, folder)
    state.write_state(current(spark, {"key": "b"}), folder, "2026-09-24", base=base)
    with pytest.raises(state.Superseded, match="version 1"):
        state.write_state(current(spark, {"key": "c"}), folder, "2026-09-24", base=base)
    assert [r.key for r in state.read_state(spark, folder).collect()] == ["b"]
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/data").select("key").collect()
    assert sorted(r.key for r in written) == ["a", "b", "c"]
    with pytest.raises(state.Superseded):
        state.write_state(current(spark), folder, "2026-09-24", base=None, touched=[1])  # thinks that there is no version yet


def test_runs_on_a_state_folder(spark, rules, tmp_path):
    """The same as runs on the whole table, with fewer buckets written; a repeated date changes nothing."""
    folder, plain = str(tmp_path / "state"), spark.createDataFrame([], POSTINGS_CURRENT)
    days = [("2026-09-24", [{"url": f"https://x.com/{i}", "title": f"Rose Gardener {i}", "posted_raw": "2026-09-20" if i else "2026-09-05"} for i in range(12)]),
            ("2026-09-25", [{"url": "https://x.com/3?utm_source=z", "title": "Rose Gardener 3", "posted_raw": "2026-09-25"},
                            {"url": "https://y.com/9", "title": "Rose Gardener 4", "posted_raw": "2026-09-24"}]),  # continues a row by company, title, place
            ("2026-09-26", [{"url": "https://x.com/5", "title": "Rose Gardener 5", "posted_raw": "2026-08-01"}])]
    for date, changes in days:
        as_of = F.lit(date).cast("date")
        probes = spark.createDataFrame([(f"slug{date[-1]}",), ("again",)], "slug string")
        found = daily_run.run_on_state(raw(spark, *changes), folder, as_of, date, rules, buckets=16, completed_probes=probes)
        whole = daily_run.run(raw(spark, *changes), plain, as_of, rules)
        plain = spark.createDataFrame(conform(whole.current, POSTINGS_CURRENT).collect(), POSTINGS_CURRENT)
        assert sorted(map(str, state.read_state(spark, folder).collect())) == sorted(map(str, plain.collect()))
        assert found.counts == whole.counts
        before = state.current_version(spark, folder)
        assert daily_run.run_on_state(raw(spark, *changes), folder, as_of, date, rules) is None
        assert state.current_version(spark, folder) == before
    assert plain.count() == 11 and {r.first_seen for r in plain.collect()} == {date_of(2026, 9, 24)}
    assert [(r.raw, r.accepted, r.new, r.cumulative, r.removed) for r in state.history(spark, folder).orderBy("run_id").collect()] == [
        (12, 12, 12, 12, 0), (2, 2, 0, 12, 0), (1, 0, 0, 11, 1)]
    probed = state.read_table(spark, folder, "probes", "slug string, probed_on date")
    assert sorted((r.slug, r.probed_on.day) for r in probed.collect()) == [("again", 26), ("slug4", 24), ("slug5", 25), ("slug6", 26)]


def test_a_run_that_touches_one_bucket_writes_one(spark, rules, tmp_path):
    folder = str(tmp_path / "state")
    rows = [{"url": f"https://x.com/{i}", "title": f"Rose Gardener {i}", "company": f"Firm {i}"} for i in range(30)]
    day = F.lit("2026-09-24").cast("date")
    daily_run.run_on_state(raw(spark, *rows), folder, day, "2026-09-24", rules, buckets=16)
    daily_run.run_on_state(raw(spark, {**rows[4], "posted_raw": "2026-09-24"}), folder, day, "2026-09-25", rules)
    assert len(state.current_version(spark, folder)["written"]) == 1 and state.read_state(spark, folder).count() == 30


def test_stored_rows_without_a_sector_get_one_in_any_bucket(spark, rules, tmp_path):
    """A run that touches nothing else classifies them by name and address, as a run on the whole table does."""
    folder, day = str(tmp_path / "state"), F.lit("2026-09-24").cast("date")
    stored = current(spark, *({"key": f"k{i}", "company": f"Firm {i}", "company_type": "" if i % 2 else L.MEDIA} for i in range(12)))
    state.write_state(stored, folder, "2026-09-10", buckets=16)
    nothing = raw(spark, {"url": "https://x.com/1", "title": "Plumber"})
    found = daily_run.run_on_state(nothing, folder, day, "2026-09-24", rules)
    whole = daily_run.run(nothing, stored, day, rules)
    types = {r.key: r.company_type for r in state.read_state(spark, folder).collect()}
    assert types == {r.key: r.company_type for r in whole.current.collect()}
    assert set(types.values()) == {L.MEDIA, L.OTHER} and found.counts == whole.counts


def test_lenient_state(spark):
    df = spark.createDataFrame([('{"title":"T","key":"k","nope":1,"date_iso":"2026-09-01","ord":3}',), ("{}",)], "json string")
    rows = state.parse_state(df).orderBy("key").collect()
    assert rows[1].date_iso == date(2026, 9, 1) and rows[1].company_type == "" and rows[0].date_iso is None


def test_report(spark, tmp_path):
    statuses = spark.createDataFrame([("u1", "A", "m", L.OK, "", 1, 0), ("u2", "a", "m", L.OK, "", 0, 1)],
                                     "url string, site string, method string, status string, error string, count long, ord long")
    nothing = spark.createDataFrame([], POSTINGS_CURRENT)
    tables = report.report_tables(nothing, current(spark, {"key": "a"}), statuses)
    folder = str(tmp_path / "report")
    report.write_report(tables, folder, "2026-09-24", csv=True)
    assert report.report_verify(spark, folder, "2026-09-24", 0)
    with pytest.raises(ValueError):
        report.report_verify(spark, folder, "2026-09-24", 1)
    assert spark.read.parquet(f"{folder}/sites/run_date=2026-09-24").count() == 1
    for day in ("25", "26"):
        report.write_report(tables, folder, f"2026-09-{day}")
    assert len(report.prune_reports(spark, folder, keep=2)) == 4


def test_report_files_in_the_order_of_their_names(spark, tmp_path):
    rows = [{"key": f"k{i}", "title": f"t{i * 37 % 101}", "ord": i, "company_type": (L.MEDIA, L.RETAIL)[i % 2]} for i in range(100)]
    statuses = spark.createDataFrame([], "url string, site string, method string, status string, error string, count long, ord long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables = report.report_tables(current(spark, *rows).limit(0), current(spark, *rows).repartition(5), statuses)
        want = [r.title for r in tables["cumulative"].collect()]
        report.write_report(tables, str(tmp_path), "2026-09-24", csv=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted((tmp_path / "csv/cumulative/run_date=2026-09-24").glob("part-*"))
    read = [line.split(",")[0] for file in files for line in file.read_text().splitlines()[1:]]
    assert read == want and len(files) > 1 and len(want) == 100


def test_link_status(spark):
    log = spark.createDataFrame([
        ("ok", "page", 1, 200, True), ("gone", "page", 1, 404, True), ("gone", "page", 2, 500, True), ("err", "search", 1, 404, True),
        ("wall", "search", 1, 999, True), ("later", "board", 1, 200, True), ("later", "board", 3, 404, True),
        ("late", "page", 1, 200, False), ("slow", "page", 1, 200, True), ("slow", "page", 2, 200, False), ("slow", "page", 3, 500, True),
        ("bot", "guarded", 1, 403, True)], "url string, family string, page int, code int, in_time boolean")
    out = {r.url: (r.status, r.error) for r in fetches.link_status(log).collect()}
    assert out == {"ok": (L.OK, ""), "gone": (L.UNREACHABLE, "HTTP 404"), "err": (L.FAILED, "HTTP 404"),
                   "wall": (L.UNREACHABLE, "HTTP 999"), "later": (L.PARTIAL, L.STOPPED_AT_PAGE + " 3: HTTP 404"),
                   "late": (L.PARTIAL, L.NOT_SCANNED), "slow": (L.PARTIAL, f"{L.STOPPED_AT_PAGE} 2: {L.TIME_OVER}"),
                   "bot": (L.UNREACHABLE, "HTTP 403")}


def test_discovery(spark):
    seen = spark.createDataFrame([("Blue Sky Ltd", "s1", 1), ("Red Co", "s2", 2)], "company string, site string, ord long")
    slugs = discovery.company_slugs(seen)
    probed = spark.createDataFrame([("bluesky", date(2026, 9, 1)), ("red", date(2026, 8, 1))], "slug string, probed_on date")
    plan = discovery.probe_plan(slugs, probed, F.lit("2026-09-24").cast("date"))
    assert [(r.rank, r.slug) for r in discovery.probe_rank_cap(plan, 9).collect()] == [(0, "red"), (1, "blue-sky"), (2, "blue")]
    assert [r.slug for r in discovery.probe_rank_cap(plan, 1).collect()] == ["red"]
    assert discovery.probe_kinds(plan).count() == 15
    done = spark.createDataFrame([("red",)], "slug string")
    assert sorted(r.slug for r in discovery.probe_leftover(plan, done).collect()) == ["blue", "blue-sky"]
    found = spark.createDataFrame([("lever", "A", "x", 1), ("lever", "a", "y", 2), ("odd", "z", "", 3), ("ashby", "seed", "", 4)],
                                  "kind string, slug string, company string, ord long")
    known = spark.createDataFrame([("ashby", "SEED")], "kind string, slug string")
    assert [(r.kind, r.slug, r.company) for r in discovery.boards_new(discovery.union_boards(found), known).collect()] == [
        ("lever", "A", "x")]


def test_vocabulary_table(spark, rules):
    rows = [("home_terms", "", "Gotham", False, 1), ("listed_titles", "", "bat watcher", False, 1),
            ("keywords", "Batarang", "batarang", False, 1), ("excluded_regions", "East", "arkham", False, 1)]
    own = rules_from_table(spark.createDataFrame(rows, VOCAB), rules)
    assert own.home_terms == ("Gotham",) and own.excluded_regions == (("East", ("arkham",)),)
    with pytest.raises(ValueError):
        rules_from_table(spark.createDataFrame([("typo", "", "x", False, 1)], VOCAB), rules)


def test_matchers(spark):
    vocab = spark.createDataFrame([("a", "C++"), ("a", "c"), ("a", "R&D team"), ("b", "x y z")], "list string, term string")
    out = {r["list"]: (r.terms, r.pattern) for r in vocabulary.terms_to_matcher(vocab).collect()}
    assert out["a"][0] == 2 and "r d team|c" in out["a"][1]
    cut = vocabulary.terms_to_matcher(vocab, chunk_terms=1).collect()
    assert sum(r.terms for r in cut if r["list"] == "a") == 2 and all(r.pattern for r in cut)
    docs = spark.createDataFrame([(1, "the R&D team, c."), (2, "xy z x-y/z"), (3, "")], "ord int, text string")
    hits = vocabulary.match_terms(docs, "text", vocab).collect()
    assert sorted((r.ord, r["list"], r.term) for r in hits) == [(1, "a", "c"), (1, "a", "r d team"), (2, "b", "x y z")]
    assert vocabulary.match_terms(docs, "text", vocab.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1 << 22, 512, 64])
def test_terms_are_tested_before_anything_is_shuffled(spark, monkeypatch, most):
    """With a filter of the wanted size, with one that is too small, and with none."""
    monkeypatch.setattr(vocabulary, "MOST_BITS", most)
    terms = [f"t{i}" for i in range(0, 300, 3)] + ["t1 t2 t4 t5 t7 t8 t9", "t9 t10"]
    vocab = spark.createDataFrame([("v", t) for t in terms], "list string, term string")
    texts = [" ".join(f"t{(i * 7 + k) % 400}" for k in range(30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    found = vocabulary.match_terms(docs, "text", vocab)
    want = sorted((i, t) for i, text in enumerate(texts) for t in terms if f" {t} " in f" {text} ")
    assert sorted((r.ord, r.term) for r in found.collect()) == want
    if most > 1000:
        may_be = vocabulary.term_filter(vocab.select("term"), len(terms))
        words = spark.range(4000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("w"))
        passed = words.where(may_be(F.col("w")))
        assert passed.where("cast(substring(w, 2) as int) % 3 = 0 and cast(substring(w, 2) as int) < 300").count() == 100 and passed.count() < 500


def test_stream_upsert_applies_a_batch_once(spark, rules, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "state")
    as_of = lambda _: F.lit("2026-09-24").cast("date")
    raw(spark, {}, {"url": "https://x.com/2", "title": "Rose Gardener"}).coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def go(log):
        stream = spark.readStream.schema(schema).parquet(str(source))
        stream_upsert(stream, folder, str(tmp_path / log), as_of, "2026-09-24", rules).awaitTermination()

    go("log")
    version = state.current_version(spark, folder)
    assert state.read_state(spark, folder).count() == 2 and version["batch_id"] == 0
    go("log-lost")  # the log was lost: the batch comes again and is skipped
    assert state.current_version(spark, folder) == version
    raw(spark, {"url": "https://x.com/3", "title": "Market Gardener"}, {}).write.mode("append").parquet(str(source))
    go("log")
    assert sorted(r.title for r in state.read_state(spark, folder).collect()) == ["Kitchen Gardener", "Market Gardener", "Rose Gardener"]


def test_stream_visit_once(spark, tmp_path):
    source = str(tmp_path / "visits")
    rows = [(datetime(2026, 9, 1, 10), "https://a.com/x?utm_source=1"), (datetime(2026, 9, 2, 10), "http://www.a.com/x/"),
            (datetime(2026, 9, 3, 10), "https://a.com/y")]
    spark.createDataFrame(rows, "ts timestamp, url string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, url string").parquet(source)
    out = str(tmp_path / "out")
    stream_visit_once(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url_key for r in spark.read.parquet(out).collect()) == ["https://a.com/x", "https://a.com/y"]


def test_stream_equals_runs_of_its_batches(spark, rules, tmp_path):
    """Three files, one a batch, are three runs, whether the stream goes through or is stopped after the first."""
    days = [[{"url": f"https://x.com/{i}", "title": f"Rose Gardener {i}"} for i in range(3)],
            [{"url": "https://x.com/1", "title": "Rose Gardener 1", "posted_raw": "2026-09-23"}, {"url": "https://x.com/7", "title": "Market Gardener"}],
            [{"url": "https://x.com/2", "posted_raw": "2026-08-01"}]]
    as_of = lambda _: F.lit("2026-09-24").cast("date")
    plain = spark.createDataFrame([], POSTINGS_CURRENT)
    source = tmp_path / "in"
    folder = str(tmp_path / "state")

    def go():
        stream = spark.readStream.schema(raw(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        stream_upsert(stream, folder, str(tmp_path / "log"), as_of, "2026-09-24", rules).awaitTermination()

    for number, changes in enumerate(days):
        raw(spark, *changes).coalesce(1).write.mode("append").parquet(str(source))
        if number != 1:  # the second and the third file come in one start
            go()
        whole = daily_run.run(raw(spark, *changes), plain, as_of(None), rules)
        plain = spark.createDataFrame(conform(whole.current, POSTINGS_CURRENT).collect(), POSTINGS_CURRENT)
    assert sorted(map(str, state.read_state(spark, folder).collect())) == sorted(map(str, plain.collect()))
    assert state.history(spark, folder).count() == 3
