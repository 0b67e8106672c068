import random

import pytest

from siftline.operators import dedupe, firsts

SCHEMA = "ord long, key string, alt_key string, company_title string, is_low_priority boolean"


def sequential(rows):
    """The rule as a plain loop over the rows in (low priority, ord) order."""
    keys, alts, titles, kept = set(), set(), set(), []
    for ord_, key, alt, title, low in sorted(rows, key=lambda r: (r[4], r[0])):
        if key in keys or alt in alts or (low and title in titles):
            continue
        keys.add(key)
        alts.add(alt)
        titles.add(title)
        kept.append(ord_)
    return sorted(kept)


def survivors(spark, rows, **limit):
    return sorted(r.ord for r in dedupe.greedy_survivors(spark.createDataFrame(rows, SCHEMA), **limit).collect())


def test_chain_keeps_both_ends(spark):
    rows = [(1, "k1", "a1", "t1", False), (2, "k2", "a1", "t1", False), (3, "k2", "a2", "t2", False)]
    assert survivors(spark, rows) == [1, 3]


def test_low_priority_also_by_company_and_title(spark):
    rows = [(1, "k1", "a1", "t", True), (2, "k2", "a2", "t", False), (3, "k3", "a3", "u", True), (4, "k4", "a4", "u", True),
            (5, "k5", "a5", "t", False)]
    assert survivors(spark, rows) == [2, 3, 5]


def test_empty(spark):
    assert survivors(spark, []) == []


def test_rows_are_kept_whole(spark):
    rows = [(1, "k1", "a1", "t1", False), (2, "k1", "a2", "t2", False)]
    assert [tuple(r) for r in dedupe.greedy_dedupe(spark.createDataFrame(rows, SCHEMA)).collect()] == rows[:1]


def test_a_missing_identity_is_shared_with_nobody(spark):
    rows = [(1, None, None, None, False), (2, None, None, None, True), (3, None, "a", "t", False), (4, "k", "a", None, True), (5, "k", None, "t", True)]
    for limit in (1, 100):
        assert survivors(spark, rows, one_by_one=limit) == [1, 2, 3]


@pytest.mark.parametrize("limit", [2048, 100])
def test_long_chains_need_no_rounds_unless_they_are_large(spark, monkeypatch, limit):
    """Chains of a thousand rows, each row sharing one identity with the one before."""
    rng = random.Random(limit)
    rows, at = [], list(range(2200))
    rng.shuffle(at)
    for chain in range(2):
        rows += [(at[1000 * chain + i], f"{chain}c{(i + 1) // 2}", f"{chain}d{i // 2}", f"t{i % 7}", i % 11 == 0 and chain == 1) for i in range(1000)]
    rows += [(at[2000 + i], f"p{i // 2}", f"q{i}", f"p{i}", False) for i in range(200)]
    called = []
    rounds = dedupe._rounds
    monkeypatch.setattr(dedupe, "_rounds", lambda rows: called.append(rows.count()) or rounds(rows))
    # with a limit of 100 only the short chains are decided in one pass; random order keeps the alternating chains of the others short
    assert survivors(spark, rows, one_by_one=limit) == sequential(rows)
    assert called == ([0] if limit > 1000 else [2000])


@pytest.mark.parametrize("limit", [2048, 5])
def test_random_against_the_loop(spark, limit):
    rng = random.Random(7)
    for size in (12, 40, 150):
        rows = []
        for i in range(size):
            alt = rng.randrange(size // 3 + 1)
            rows.append((i, f"k{rng.randrange(size // 2)}", f"a{alt}", f"t{alt % 4}", rng.random() < 0.3))
        assert survivors(spark, rows, one_by_one=limit) == sequential(rows)


def test_hot_group(spark):
    """A third of all rows share one key, another third one alt_key; one long chain links rows."""
    rows = [(i, "hot", f"a{i}", f"t{i}", False) for i in range(400)]
    rows += [(1000 + i, f"k{i}", "hot", "t", False) for i in range(400)]
    rows += [(2000 + i, f"c{(i + 1) // 2}", f"d{i // 2}", "x", i % 5 == 0) for i in range(12)]
    assert survivors(spark, rows) == sequential(rows)


def test_first_per_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", f"v{i}") for i in range(60)], "ord long, key string, v string")
    got = {r.key: r.v for r in firsts.first_per_key(df, ["key"]).collect()}
    assert got["hot"] == "v1" and len(got) == 21
    assert {r.key: r.v for r in firsts.first_per_key(df, ["key"], last=True).collect()}["hot"] == "v59"


def test_visit_once(spark):
    df = spark.createDataFrame([(1, "https://a.com/x?utm_a=1"), (2, "http://www.a.com/x/"), (3, "https://a.com/y")],
                               "ord long, url string")
    assert sorted(r.ord for r in firsts.visit_once(df).collect()) == [1, 3]


def test_repeated_order_is_an_error(spark):
    rows = [(1, "k1", "a1", "t1", False), (1, "k2", "a2", "t2", False)]
    with pytest.raises(ValueError, match="ord must be unique"):
        survivors(spark, rows)


def test_components(spark):
    from siftline.operators.components import components

    rng = random.Random(5)
    pairs = [*((i, i + 1) for i in range(60)), *((1000, i) for i in range(101, 900)), *((rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)),
             (7, 7), (None, 3), (5000, 12)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {i: root(i) for i in parent if root(i) != i}
    got = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
