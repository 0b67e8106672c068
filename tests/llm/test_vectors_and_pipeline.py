"""Vector operators against brute force and SQL, components, and the stages of the pipeline."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import components, embedding_dedup, line_dedup, pivot_search, queries, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, cell int, home int, x int, score double, query boolean, n long"


def brute_links(data, threshold=0.98):
    """{id: (links, component)} of (id, vector, label) rows with distinct ids."""
    good = {i: (np.array(v, float), label) for i, v, label in data if i is not None and label is not None and v
            and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j, (w, m) in good.items() if i != j and label == m and len(v) == len(w)
                and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold} for i, (v, label) in good.items()}
    out = {}
    for i, _, _ in data:
        if i is None:
            continue
        seen, queue = {i}, [i]
        while queue:
            for j in near.get(queue.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        out[i] = (len(near.get(i, ())), min(seen))
    return out


def clustered(random, n, width=16):
    centres = random.normal(size=(8, width))
    return [(int(i), (centres[i % 8] + random.normal(scale=0.09, size=width)).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def test_near_duplicates_with_edges(spark):
    random = np.random.default_rng(1)
    data = clustered(random, 400)
    one = data[0][1]
    data += [(1000, one, 0), (1001, one, 0), (1002, [2 * x for x in one], 0), (1003, one, 1), (1004, one, None), (1005, None, 0), (1006, [], 0),
             (1007, [0.0] * 16, 0), (1008, [None, *one[1:]], 0), (1009, [math.nan, *one[1:]], 0), (1010, [math.inf, *one[1:]], 0),
             (1011, one[:5], 0), (1012, one[:5], 0), (1013, [-0.0] * 16, 0)]
    extra = (1, 2, 3, 4.0, True, 5)
    df = spark.createDataFrame([(*r, *extra) for r in [*data, (None, one, 0), data[3]]], SCHEMA)
    want = brute_links(data)
    got = embedding_dedup.near_duplicates(df, codewords=4).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert len(got) == len(data) + 2 and [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, None)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_hot_cells_lose_nothing(spark, monkeypatch):
    data = clustered(np.random.default_rng(2), 240)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4.0, True, 5) for r in data], SCHEMA)
    monkeypatch.setattr(vectors.compare_cells, "__defaults__", (16,))
    got = embedding_dedup.near_duplicates(df, codewords=2).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(data)


def test_visits_are_all_cells_within_reach_nearest_first():
    random = np.random.default_rng(3)
    for _ in range(50):
        lower = random.random(6), random.random(5)
        lower[0][2] = lower[1][1] = 0
        cells = embedding_dedup.visits(lower, 0.7)
        far = [lower[0][a] + lower[1][b] for a, b in cells]
        assert far == sorted(far) and set(cells) == {(a, b) for a in range(6) for b in range(5) if lower[0][a] + lower[1][b] <= 0.7}


@pytest.mark.parametrize("name, order", [("op1_embedding_dedup", ["vec_id"]), ("op2_pivot_search", ["query_id", "rank"])])
def test_queries_against_sql(spark, name, order):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df().sort_values(order)
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)].sort_values(order)
    assert got.values.tolist() == want.values.tolist()


def test_search_edges(spark):
    random = np.random.default_rng(4)
    data = [(int(i), random.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]  # many ties
    good = [*data, (900, [0.0] * 6)]
    odd = [(901, None), (902, [None] * 6), (903, [math.nan] * 6), (904, [1.0]), (None, data[0][1]), data[5]]
    df = spark.createDataFrame([(*r, 1, True) for r in [*good, *odd]], "vec_id long, vector array<double>, cell int, distance boolean")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 30 == 0, k=4, pivots=5).collect()}
    want = {}
    for q, x in good:
        if q % 30 == 0:
            best = sorted((-float(np.dot(x, y)), i) for i, y in good if i != q)[:4]
            want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<double>")
    assert [tuple(r) for r in pivot_search.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert pivot_search.top_k(few.limit(0), F.lit(True)).count() == 0


def test_components(spark):
    random = np.random.default_rng(5)
    pairs = [*((i, i + 1) for i in range(0, 60)), *((100, i) for i in range(101, 400)),
             *(tuple(map(int, p)) for p in random.integers(1000, 1400, (250, 2))), (7, 7), (None, 3)]
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
    got = components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert dict(map(tuple, got.collect())) == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pipeline_stages(spark):
    from .test_text_operators import brute_print, packed_ids, roots_of

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_deduplication", "simhash_near_duplicates", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    accepted = stages[0](spark, docs, sf_dir)
    ids = {r.doc_id for r in accepted.collect()}
    assert accepted.columns == docs.columns
    assert all((i in ids) == (quality == 1) for i, quality in labels.items())
    lines = stages[1](spark, accepted, sf_dir)
    assert lines.columns == docs.columns and {r.doc_id for r in lines.collect()} == ids
    kept = stages[2](spark, lines, sf_dir)
    prints = [(r.doc_id, brute_print(r.text or "")) for r in lines.collect()]
    linked = [(a, b) for k, (a, p) in enumerate(prints) for b, q in prints[:k] if (p ^ q).bit_count() <= 2]
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(roots_of(ids, linked).values())
    pieces = stages[3](spark, kept, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: len(x) for i, x in packed_ids(kept)}
    assert queries.QUERIES["pipeline"](spark, sf_dir).agg(F.sum("length")).first()[0] == sum(r.n for r in pieces)


def test_pipeline_removes_short_lines_of_many_sites(spark):
    data = [(i, f"own {i}\nAll rights reserved.\n \n版権所有", "en", f"site{i}", 0) for i in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert got == {i: (data[i][1], 0) if i == 0 else (f"own {i}\n ", 7) for i in range(9)}


def test_pipeline_decides_each_row_by_its_own_score(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    good, bad = (docs.join(labels.where(F.col("quality") == q), "doc_id", "left_semi").orderBy("doc_id").first() for q in (1, 0))
    odd = [(None, good.text), (None, bad.text), (good.doc_id, bad.text)]
    more = spark.createDataFrame([(i, text, "en", "s", 0) for i, text in odd], "doc_id long, text string, lang string, source string, n_chars long")
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    kept = corpus_pipeline.quality_classifier(spark, docs.unionByName(more), sf_dir)
    found = kept.where(F.col("doc_id").isNull() | (F.col("doc_id") == good.doc_id)).select("doc_id", "text").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, good.text), (good.doc_id, good.text)], key=str)
    assert [r.doc_id for r in corpus_pipeline.simhash_near_duplicates(spark, more.limit(2), sf_dir).collect()] == [None, None]


def test_search_within_each_length(spark):
    random = np.random.default_rng(7)
    data = [(int(i), random.integers(-9, 10, 6 if i % 3 else 4).astype(float).tolist()) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 10 == 0, k=3, pivots=4).collect()}
    want = {}
    for q, x in data[::10]:
        best = sorted((-float(np.dot(x, y)), i) for i, y in data if i != q and len(x) == len(y))[:3]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want


def test_pipeline_keeps_columns_with_clashing_names(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({
        "_row": F.lit(-5), "removed_lines": F.lit("mine"), "predicted": F.lit(9), "line": F.lit("l"), "doc": F.lit(1), "gone": F.lit(2), "key": F.lit(3)})
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.line_deduplication, corpus_pipeline.simhash_near_duplicates):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert [tuple(r) for r in kept.select("_row", "removed_lines", "predicted", "line", "doc", "gone", "key").distinct().collect()] == [
            (-5, "mine", 9, "l", 1, 2, 3)]
    cleaned = line_dedup.remove_boilerplate(docs)
    assert cleaned.columns.count("removed_lines") == 1 and cleaned.agg(F.max("removed_lines")).first()[0] > 0
    nulls = docs.withColumn("text", F.lit(None).cast("string"))
    for stage in corpus_pipeline.STAGES[:3]:
        assert stage[1](spark, docs.limit(0), sf_dir).count() == 0
        stage[1](spark, nulls, sf_dir).count()
