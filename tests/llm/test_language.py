"""Language identification: features against a plain count, machines, odd rows, held-out accuracy."""

from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import language, queries

SCHEMA = "doc_id long, text string, lang string, source string, x binary, late boolean, place int, one int, score double, held_out int"
CLASH = ("s", b"", True, 1, 1, 0.5, 2)


def brute_features(text):
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    counts = Counter(spaced[i:i + n] for n in (1, 2, 3) for i in range(len(spaced) - n + 1))
    total = np.zeros(language.BUCKETS)
    for gram, times in counts.items():
        key = 0
        for n, c in enumerate(gram, 1):
            key = (key * 1_000_003 + (ord(c) if c != " " else 0) + n) % (1 << 64)
        total[key * 0x9E3779B97F4A7C15 % (1 << 64) >> 53] += times
    return np.sqrt(total / total.sum()) if spaced.strip() else None


@pytest.mark.parametrize("cut", [1 << 19, 1, 2, 5])
def test_features_against_a_plain_count(monkeypatch, cut):
    monkeypatch.setattr(language, "SLICE", cut)
    grams = language.NGrams()
    for text in ("Ab, cd!", "x", " été\n\n123 ÊTRE  z", "日本語 text", "𝔸𝔹 c", "a" * 40 + "1" * 30 + "b", "...a..b"):
        assert np.allclose(grams.of(text), brute_features(text), atol=1e-6), text
    assert [grams.of(t) for t in ("", "12 - 3", "...", "\n")] == [None] * 4


def test_families_and_machines():
    random = np.random.default_rng(1)
    centres = np.eye(6)[[0, 0, 1, 1, 2]] + 0.2 * np.eye(6)[[3, 4, 3, 5, 5]]
    assert sorted(map(sorted, language.related(centres))) == [[0, 1], [2, 3], [4]]
    y = random.integers(0, 5, 1000)
    x = (centres[y] + random.normal(scale=0.03, size=(1000, 6))).astype(np.float32)
    model = language.fit(x, y, np.arange(1000) % 4 == 0, list("abcde"))
    found, score = model.predict(x)
    assert (found == y).all() and len(model.pairs) == 2 and ((0 <= score) & (score <= 1)).all() and score.min() > 0.5
    flat = language.fit(x, y, np.arange(1000) % 4 == 0, list("abcde"), dict.fromkeys("abcde", "one"))
    assert (flat.predict(x)[0] == y).all() and len(flat.pairs) == 10
    one = language.fit(x[y == 0], y[y == 0] * 0, np.zeros((y == 0).sum(), bool), ["a"])
    assert one.predict(x)[0].tolist() == [0] * 1000


def test_odd_rows(spark):
    english = ["the house is on the hill and the river runs below it", "this is what they think of that", "who would have thought such a thing"]
    german = ["das haus steht auf dem berg und der fluss ist unten", "ich weiß nicht was das sein soll", "wer hätte so etwas gedacht und gesagt"]
    data = [(i, f"{(english if i % 2 else german)[i % 3]} {i}", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 ... 7", "en"), (103, "the river and the hill " * 40_000, None), (None, "der berg und das haus", "en"),
           (105, "und", "und"), data[4], data[4], (4, "der berg", "fr")]
    df = spark.createDataFrame([(*r, *CLASH) for r in [*data, *odd]], SCHEMA)
    rows = language.identify(df, sample=40).collect()
    assert len(rows) == len(data) + len(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0] == "en" and got[None][0] == "de" and got[105][0] != "und"
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(got[i][0] == lang for i, _, lang in data if i != 4)
    nothing = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    assert language.identify(df.limit(0)).count() == 0


def test_predictions_depend_on_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    twins = docs.where(language.fold() == 2).select((-F.col("doc_id") - 1000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit("").alias("source"))
    both = language.identify(docs.select(twins.columns).unionByName(twins)).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in both}
    pairs = [(found[-i - 1000], found[i]) for i in found if i >= 0 and -i - 1000 in found]
    assert len(pairs) > 20 and all(a == b for a, b in pairs)


def test_held_out_accuracy(spark):
    for sf, least in (("sf0.01", 0.99), ("sf0.1", 0.999)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "lang")
        got = queries.QUERIES["op11_language"](spark, f"/root/testdata/{sf}").join(docs, "doc_id")
        held = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
        assert held[0] >= least and held[1] > 200 and got.count() == docs.count()
