"""Every registered posting query next to its SQL twin on the smallest tables, and checks of the plans.

The training-data queries, where they are there, have tests of their own.
"""

import os

import pytest

SF_DIR = os.environ.get("SIFTLINE_TEST_SF", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def _names():
    from siftline.plans.registry import all_queries

    return sorted(all_queries())


@pytest.fixture(scope="module")
def duck():
    from sqltwins.compare import connect

    return connect(SF_DIR)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    import __spark_entry__ as entry
    from sqltwins.compare import check

    _, _, verdict = check(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["title_class", "classify_location", "evaluate", "find_keywords", "parse_posting_date",
                                  "extract_jsonld_posting", "labeled_fields", "flatten_payload_lever", "boards_in_page"])
def test_row_work_needs_no_shuffle_and_no_python(spark, name):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(entry.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the only exchange is the one that spreads a small single-file table over the cores
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")
    assert not any(node in plan for node in ("MapInPandas", "BatchEvalPython", "ArrowEvalPython", "PythonMap"))


@pytest.mark.parametrize("name", ["retract_join", "match_terms", "board_names", "boards_new", "probe_plan", "detail_join",
                                  "reason_counts", "removed_count", "apply_company_types", "status_counts"])
def test_joins_are_equality_joins(spark, name):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_columns_are_pruned_at_the_scan(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["company_key"](spark, SF_DIR))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_size:" in plan


@pytest.mark.parametrize("name", [
    "fold_gender", "normalize_title", "fold_place_spelling", "split_locations", "company_key", "location_key",
    "parse_posting_date", "relevant_date", "freshness", "date_display", "title_class", "is_potential", "title_says_abroad",
    "predetail_prune", "board_has_home_jobs", "board_from_url", "workday_base", "jobvite_rewrite", "jsonld_location",
    "search_result_links"])
def test_queries_work_on_values_not_only_on_ids(spark, name):
    import re

    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    plan += _plan(entry.queries()[name](spark, SF_DIR))
    scanned = {column for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for column in re.findall(r"(\w+):", schema)}
    assert scanned - {"doc_id", "c_custkey", "o_orderkey", "p_partkey"}


def test_a_library_that_is_missing_takes_no_other_query_away(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("siftline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    monkeypatch.setitem(sys.modules, "siftline.llm.token_counts", None)
    assert sorted(entry.queries()) == _names() and set(entry.oracle_sql()) <= set(_names())
