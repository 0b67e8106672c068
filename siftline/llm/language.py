"""Language identification by levels: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .tokenizing import once

BUCKETS = 1 << 11  # of n-grams
LONGEST = 3  # letters of an n-gram
SLICE = 1 << 19  # characters whose n-grams are counted at a time
UNKNOWN = "und"


class NGrams:
    """Texts to the square roots of their shares of n-grams, 1 to LONGEST characters of small letters, hashed into buckets.

    What isn't a letter counts as one space, however much of it there is; a text starts and ends with one.
    """

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def _codes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        return np.where(self.letter[codes.astype(np.int64)], codes, 0)

    @staticmethod
    def _counts(codes: np.ndarray, old: int) -> np.ndarray:
        """Counts of the n-grams that end after the first ``old`` codes; 0, the space, isn't repeated."""
        total = np.zeros(BUCKETS)
        key = np.zeros(len(codes), np.uint64)
        for n in range(1, LONGEST + 1):
            key = key[:len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1:] + np.uint64(n)
            hashed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)
            total += np.bincount(hashed[max(old - n + 1, 0):].astype(np.int64), minlength=BUCKETS)
        return total

    def of(self, text: str) -> np.ndarray | None:
        """The features of a whole text, in slices; None, if it has no letter."""
        total, held, old = np.zeros(BUCKETS), np.zeros(1, np.uint64), 0
        letters = False
        for at in range(0, len(text) + 1, SLICE):
            codes = np.r_[held, self._codes(text[at:at + SLICE]), np.zeros(int(at + SLICE > len(text)), np.uint64)]
            codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
            letters = letters or bool(codes.any())
            total += self._counts(codes, old)
            held = codes[-LONGEST + 1:]
            old = len(held)
        return np.sqrt(total / total.sum()).astype(np.float32) if letters else None


def _machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; the last weight is the bias. ``y`` is 1 or -1."""
    middle = x.mean(axis=0)
    rows = np.c_[x - middle, np.ones(len(x), x.dtype)]
    some = np.ones(rows.shape[1], x.dtype)
    for _ in range(10):
        some = rows.T @ (rows @ some)
        some /= np.linalg.norm(some)
    share = c / len(rows)
    step = 1 / (1 + 2.2 * share * np.linalg.norm(rows @ some) ** 2)
    w = ahead = np.zeros(rows.shape[1], x.dtype)
    for k in range(rounds):
        slope = ahead - 2 * share * (rows.T @ (y * np.maximum(1 - y * (rows @ ahead), 0)))
        new = ahead - step * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    return np.r_[w[:-1], w[-1] - w[:-1] @ middle]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _steepness(margins: np.ndarray, y: np.ndarray) -> float:
    """The factor that makes margins the likeliest log odds; 2, where there is nothing to fit it to."""
    if not len(y):
        return 2.0
    return float(min(np.exp(np.linspace(0, np.log(30), 40)), key=lambda a: np.logaddexp(0, -a * y * margins).mean()))


def related(centres: np.ndarray) -> list[list[int]]:
    """Families: by average linkage of what sets languages apart, as long as two groups are more alike than languages are on average."""
    centres = centres - centres.mean(axis=0)
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    alike = unit @ unit.T
    groups = [[k] for k in range(len(centres))]
    if len(groups) < 2:
        return groups
    least = alike[np.triu_indices(len(alike), 1)].mean()
    while len(groups) > 1:
        value, a, b = max((alike[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a, b in combinations(range(len(groups)), 2))
        if value < least:
            break
        groups[-a] += groups.pop(-b)
    return groups


@dataclass
class Languages:
    """Weights of all machines, one column each: families against the rest, then pairs of languages within a family."""

    names: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    steep: np.ndarray | None = None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of languages, scores). The score is the probability of the family times that of the language within it."""
        margins = np.stack([row @ self.weights[:-1] for row in x]) + self.weights[-1]  # row by row: the same for a text in any company
        likely = _sigmoid(margins * self.steep)
        family = likely[:, :len(self.families)]
        family = family / np.maximum(family.sum(axis=1, keepdims=True), 1e-300)
        chosen = margins[:, :len(self.families)].argmax(axis=1)
        votes, sums, share = (np.zeros((len(x), len(self.names))) for _ in range(3))
        for k, (a, b) in enumerate(self.pairs, len(self.families)):
            votes[:, a] += margins[:, k] >= 0
            votes[:, b] += margins[:, k] < 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
            share[:, a] += likely[:, k]
            share[:, b] += 1 - likely[:, k]
        language, score = np.zeros(len(x), int), np.zeros(len(x))
        for f, own in enumerate(self.families):
            at = np.flatnonzero(chosen == f)
            pairs = max(len(own) * (len(own) - 1) // 2, 1)
            order = np.lexsort((sums[np.ix_(at, own)], votes[np.ix_(at, own)]), axis=1)[:, -1]
            language[at] = np.array(own)[order]
            within = share[at, language[at]] / pairs if len(own) > 1 else 1.0
            score[at] = family[at, f] * within
        return language, np.clip(score, 0, 1)


def fit(x: np.ndarray, y: np.ndarray, late: np.ndarray, names: list[str], families: Mapping[str, str] | None = None) -> Languages:
    """Machines from the rows that aren't ``late``, steepness from those that are. ``y`` are numbers of ``names``.

    ``families`` says which family a language is of (one that isn't listed is a family of its own); without it, families are learned.
    A language all of whose rows are late is learned from these.
    """
    late = late & np.isin(y, y[~late])
    if families is None:
        groups = related(np.stack([x[~late & (y == k)].mean(axis=0) for k in range(len(names))]))
    else:
        of = [families.get(name, "\0" + name) for name in names]
        groups = [[k for k, name in enumerate(of) if name == group] for group in dict.fromkeys(of)]
    model = Languages(names, groups, [pair for own in groups for pair in combinations(own, 2)])
    tasks = [(np.ones(len(y), bool), np.isin(y, own)) for own in groups] + [(np.isin(y, pair), y == pair[0]) for pair in model.pairs]
    weights, steep = [], []
    for rows, positive in tasks:
        sign = np.where(positive, 1, -1).astype(np.float32)
        early, check = rows & ~late, rows & late
        if (sign[early] == sign[early][0]).all():
            w = np.r_[np.zeros(x.shape[1], np.float32), sign[early][:1]]
        else:
            w = _machine(x[early], sign[early])
        weights.append(w)
        steep.append(_steepness(x[check] @ w[:-1] + w[-1], sign[check]))
    model.weights, model.steep = np.stack(weights, 1).astype(np.float32), np.array(steep)
    return model


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang, text) of at most ``sample`` documents, as many of each language (one at least), those with the smallest hashes of their ids."""
    known = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & (fold() != 2) & F.col("text").rlike(r"\p{L}"))
    ids = written(known.groupBy("doc_id", "lang").agg(F.lit(1).alias("one")).drop("one"), "labelled")
    quota = max(sample // max(ids.select("lang").distinct().count(), 1), 1)
    # a language may have a third of all rows: only those whose hashes are among the least, about twice as many as wanted, are put in order
    sizes = written(ids.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    place = F.xxhash64("doc_id")
    few = ids.join(sizes, "lang").where(place.cast("double") / float(1 << 64) + 0.5 < (2 * quota + 30) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = written(few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= quota).select("doc_id", "lang"), "sample")
    return known.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def identify(docs: DataFrame, sample: int = 4096, families: Mapping[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    The machines learn from at most ``sample`` documents (or one of each language) whose ``lang`` isn't null and whose fold isn't 2: folds 0
    and 1 give the weights, fold 3 the steepness of the scores. A prediction depends on the whole text alone. Texts that are null
    or have no letter are ``und`` with score 0, and so is every text where nothing is labelled. A row with a null id is not learned
    from and not held out. Of rows that repeat an id and a language one is learned from. Ties between languages go to the later name.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = once(NGrams)
        for batch in batches:
            found = [None if (x := grams.of(value.as_py())) is None else x.tobytes() for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], ["x", "lang", "late"])

    learn = _sampled(rows, sample).select("text", "lang", (fold() == 3).alias("late"))
    learn = written(learn.mapInArrow(features, "x binary, lang string, late boolean"), "features").where("x is not null").orderBy("lang", "x").toArrow()
    names = sorted(set(learn["lang"].to_pylist()))
    model = None
    if names:
        x = np.frombuffer(b"".join(learn["x"].to_pylist()), np.float32).reshape(learn.num_rows, BUCKETS)
        y = np.searchsorted(np.array(names), np.array(learn["lang"].to_pylist()))
        model = fit(x, y, np.array(learn["late"].to_pylist(), bool), names, families)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a column of BUCKETS for each family and pair of related languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = once(NGrams), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [None if model is None else grams.of(value.as_py() or "") for value in part.column(1)]
                names, scores = [UNKNOWN] * len(found), np.zeros(len(found))
                where = [k for k, x in enumerate(found) if x is not None]
                if where:
                    languages, scores[where] = model.predict(np.stack([found[k] for k in where]))
                    for k, language in zip(where, languages.tolist()):
                        names[k] = model.names[language]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    scored = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
