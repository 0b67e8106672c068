"""Text operators against brute-force versions, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import (best_fit, byte_bpe, line_dedup, quality, queries, simhash, suffix_tree, sum_squares, token_counts,
                          tokenizing)

from . import plain_suffix_tree

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, line string, row long, words string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "One two three four five six seven.", "One two three four five six seven.", "a", "a  b\n b ~ x~ \n",
         "Éé 日本語 😀 naïve", LONG, "THE!! END!!", "one TWO three four five six seven."]


def rows(texts):
    return [(i, text, "en", f"src{i % 3}", 0, "f", "l", 1, "w") for i, text in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a null id, columns with clashing names."""
    data = rows(TEXTS) + [(3, TEXTS[3], "en", None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- SimHash
def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots_of(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def check_simhash(df):
    prints = [(i, brute_print(t)) for i, t in _texts(df)]
    known = [(i, p) for i, p in prints if i is not None]
    linked = [(a, b) for k, (a, p) in enumerate(known) for b, q in known[:k] if (p ^ q).bit_count() <= 2]
    roots = roots_of({i for i, _ in known}, linked)
    want = Counter((i, f"{p:016x}", roots.get(i)) for i, p in prints)
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want


def test_simhash(documents, odd, nothing):
    check_simhash(documents)
    check_simhash(odd)
    assert simhash.near_duplicates(nothing).count() == 0


def test_crowded_blocks_lose_no_link(spark):
    random = np.random.default_rng(5)
    base = [int(x) for x in random.integers(0, 1 << 62, 12)]
    prints = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in random.integers(0, 63, (25, 2))} | set(base)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = {frozenset(r) for crowd in (2,) for r in map(tuple, simhash.links(df, crowd=crowd).collect())}
    assert all((signed_a ^ signed_b).bit_count() <= 2 or ((signed_a ^ signed_b) & (1 << 64) - 1).bit_count() <= 2 for signed_a, signed_b in map(tuple, found))
    order = list(signed)
    exact = [(a, b) for k, a in enumerate(order) for b in order[:k] if (a ^ b).bit_count() <= 2]
    back = {s: p for p, s in signed.items()}
    assert roots_of(order, exact) == roots_of(order, [tuple(back[x] for x in pair) for pair in found])


# ---------------------------------------------------------------- lines
def test_lines_of_many_sites(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = sorted(documents.columns) + ["removed_lines"]
    want = con.sql(line_dedup.SQL).df()[names].astype(str).sort_values("doc_id").values.tolist()
    got = line_dedup.remove_boilerplate(documents).toPandas()[names].astype(str).sort_values("doc_id").values.tolist()
    assert got == want and any(row[-1] != "0" for row in want)


def test_line_edges(odd, nothing):
    out = line_dedup.remove_boilerplate(odd, threshold=2)
    assert out.columns == [*odd.columns, "removed_lines"]
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.removed_lines) for r in out.collect()), key=str)
    # the line of documents 3 and 4 is on two sites: the first keeps it, also in its repeated row
    want = sorted(((i is None, i or 0, "" if i == 4 else t, int(i == 4)) for i, t in
                   [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id here at all")]), key=str)
    assert found == want
    assert line_dedup.remove_boilerplate(nothing).count() == 0


def test_counts_near_the_threshold_are_exact(spark):
    data = [(i * 100 + s, f"line number {i} with some words", f"site{s}") for i in range(40) for s in range(i)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = line_dedup.remove_boilerplate(df, threshold=20, lg_k=4, length=None)
    gone = {r.doc_id // 100 for r in out.where("removed_lines > 0").collect()}
    assert gone == set(range(20, 40))


# ---------------------------------------------------------------- tokens
def packed_ids(df):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for i, t in _texts(df)]


def check_pieces(df):
    out = sum_squares.pack(df, WORDS, with_ids=True).collect()
    whole = Counter((i, tuple(ids)) for i, ids in packed_ids(df))
    # rows that repeat an id are told apart by their starts in the sequence of pieces
    documents = defaultdict(list)
    for r in out:
        ids = np.array(r.ids, "<u4")
        assert r.length == len(ids) > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        documents[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for (i, n), pieces in documents.items():
        same = [ids for (k, ids), times in whole.items() if k == i and len(ids) == n for _ in range(times)]
        assert sum(len(ids) for _, ids in pieces) == n * len(same)
        if len(same) == 1:
            assert [x for _, ids in sorted(pieces) for x in ids] == list(same[0])
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n, _ in own)
        assert total == own[0][2] <= 2048 and (total == 2048 or total.bit_count() == 1)
        assert [at for at, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]


def test_sum_squares(documents, odd, nothing):
    check_pieces(documents)
    check_pieces(odd)
    assert sum_squares.pack(nothing, WORDS).count() == 0


def test_sum_squares_places_where_the_sum_is_least():
    random = np.random.default_rng(1)
    packer, counts = sum_squares.Packer(64), Counter()
    for n in random.integers(1, 64, 400).tolist():
        def cost(level):
            after = counts.copy()
            after[level] -= level > 0
            after[level + n] += level + n < 64
            return sum(c * c for c in after.values())
        choices = [0, *[h for h in counts if counts[h] > 0 and h + n <= 64]]
        before = packer.levels.copy()
        packer.place((None, 0, np.zeros(n, "<u4")))
        taken = [h for h in range(1, 64) if before[h] > packer.levels[h]]
        level = next((h for h in taken if h + n <= 64 and (h + n == 64 or packer.levels[h + n] > before[h + n])), 0)
        assert cost(level) == min(map(cost, choices))
        counts[level] -= level > 0
        counts[level + n] += level + n < 64


def test_best_fit_matrices(documents, odd, nothing):
    for df in (documents, odd):
        found = defaultdict(list)
        for r in best_fit.pack_matrices(df, WORDS, block_tokens=50_000).collect():
            ids, positions, ends = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4"), r.cumulative_lengths
            assert len(ids) == len(positions) == 2048 and ends[-1] == r.n_tokens and not ids[r.n_tokens:].any()
            for a, b, i, start in zip(ends, ends[1:], r.doc_ids, r.starts):
                assert positions[a:b].tolist() == list(range(b - a))
                found[i].append((start, ids[a:b].tolist()))
        want = Counter(i for i, ids in packed_ids(df))
        for i, ids in packed_ids(df):
            if want[i] == 1:
                assert [x for _, piece in sorted(found[i]) for x in piece] == ids
    assert best_fit.pack_matrices(nothing, WORDS).count() == 0


def test_best_fit_is_the_tightest():
    lengths = np.random.default_rng(2).integers(1, 65, 300)
    windows = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        fits = [(64 - sum(lengths[x] for x in w), k) for k, w in enumerate(windows) if sum(lengths[x] for x in w) + lengths[piece] <= 64]
        if fits:
            windows[min(fits)[1]].append(piece)
        else:
            windows.append([piece])
    got = best_fit.best_fit_decreasing(lengths, 64)
    assert sorted(sum(lengths[x] for x in w) for w in got) == sorted(sum(lengths[x] for x in w) for w in windows)
    assert sorted(x for w in got for x in w) == list(range(300))


ALPHABET = "aA é.,!'s\n\t  ~12日́ \0İſ½"


def test_encoders_are_exact():
    random = np.random.default_rng(3)
    texts = ["".join(ALPHABET[i] for i in random.integers(0, len(ALPHABET), n)) for n in random.integers(0, 30, 4000)]
    texts += [t or "" for t in TEXTS] + ["<|endoftext|> x", "it's THE'S", "x \n", "  ", "\x1c \x1d"]
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    for text, data in zip(texts, tokenizing.WordEncoder(WORDS).encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    exact = tiktoken.Encoding("own", pat_str=BYTES[1], mergeable_ranks=tokenizing.read_ranks(BYTES[0]), special_tokens={})
    encoder = tokenizing.ByteEncoder(*BYTES)
    for text, data in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(data, "<u4")
        assert ids.tolist() == exact.encode_ordinary(text)
        starts, ends = encoder.offsets(text, ids)
        assert all(encoder.decode(ids[k:k + 1]) in text[a:b].encode() for k, (a, b) in enumerate(zip(starts, ends)))


def test_letters_that_become_a_letter_and_a_mark():
    """A mark and what follows it are one pre-token, so a letter that isn't one any more is not cut off."""
    encoder = tokenizing.WordEncoder(WORDS)
    texts = ["\u0958. a", "x \u095c!?", "\u0130. I\u0307.", "a.'s b.'ll don't. \u00e9t\u00e9, \u0416.", "h\u0331. H\u0331. T\u0308,", "A.B. 3.5! ...z"]
    whole = [np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert list(encoder.encode(texts)) == whole


def test_a_worker_keeps_what_it_works_with_now(monkeypatch):
    monkeypatch.setattr(tokenizing, "_loaded", {})
    first = tokenizing.once(list)
    assert tokenizing.once(list) is first
    other = tokenizing.once(dict)
    assert tokenizing.once(dict) is other and list(tokenizing._loaded.values()) == [other]


def test_byte_bpe_query(spark, documents):
    exact = tiktoken.Encoding("own", pat_str=BYTES[1], mergeable_ranks=tokenizing.read_ranks(BYTES[0]), special_tokens={})
    texts = dict(_texts(documents))
    for r in queries.op10_byte_bpe(spark, SF).collect():
        ids = np.array(exact.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_round_trip_and_split_characters(spark, odd, nothing):
    encoded = byte_bpe.encode(odd, *BYTES)
    assert Counter(r.decoded_text for r in byte_bpe.decode(encoded, *BYTES).collect()) == Counter(t for _, t in _texts(odd))
    one = [r for r in encoded.collect() if r.doc_id == 7][0]
    cut = spark.createDataFrame([(7, k, [x]) for k, x in enumerate(one.ids)], "doc_id long, start long, ids array<int>")
    joined = sorted(byte_bpe.decode_pieces(cut, *BYTES).collect(), key=lambda r: r.start)
    assert "".join(r.text for r in joined) == TEXTS[7]
    assert byte_bpe.encode(nothing, *BYTES).count() == byte_bpe.decode(byte_bpe.encode(nothing, *BYTES, packed=True), *BYTES).count() == 0


# ---------------------------------------------------------------- counts
def test_token_counts(documents, odd, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter = token_counts.UnigramCounter(path)

    def brute(word):
        text = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            n = len(text[end - 1].encode())
            options = [(best[end - 1][0] + n * counter.byte, best[end - 1][1] + n)]
            options += [(best[a][0] + counter.pieces[text[a:end]], best[a][1] + 1) for a in range(end) if text[a:end] in counter.pieces]
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    for df in (documents, odd):
        want = Counter((i, len(t.split()), sum(map(brute, t.split()))) for i, t in _texts(df) if len(t) < 30_000)
        short = df.where("text is null or length(text) < 30000")
        assert Counter(map(tuple, token_counts.count_tokens(short, path).collect())) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_trie_starts_anew_without_changing_counts(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = [f"syllable{i}able" for i in range(300)]
    want = [token_counts.UnigramCounter(path).tokens(w) for w in words]
    monkeypatch.setattr(token_counts, "NODES", 50)
    small = token_counts.UnigramCounter(path)
    assert [small.tokens(w) for w in words] == want


# ---------------------------------------------------------------- classifier
def test_quality_held_out(spark, documents, odd, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([r.predicted == q for r, q in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    edge = quality.score(odd, labels.limit(0))
    assert edge.count() == odd.count() and edge.where("score is null").count() == 0
    assert quality.score(nothing, labels).count() == 0


def test_scores_depend_on_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    changed = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")).repartition(5)
    first, second = ({r.doc_id: r.score for r in quality.score(d, labels).collect()} for d in (docs, changed))
    assert first == pytest.approx(second, abs=1e-6)


def test_temperature_calibrates():
    random = np.random.default_rng(4)
    x = random.normal(size=(4000, 5))
    y = (random.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x[:2000], y[:2000])
    net.w2, net.b2 = net.w2 * 5, net.b2 * 5

    def loss():
        p = np.clip(net.probability(x[2000:]), 1e-12, 1 - 1e-12)
        return -np.mean(y[2000:] * np.log(p) + (1 - y[2000:]) * np.log(1 - p))

    before = loss()
    quality.calibrate(net, x[2000:], y[2000:])
    assert net.temperature > 1.5 and loss() < before


# ---------------------------------------------------------------- language model
def check_base(df, out):
    tokens = [(i, t.encode().lower().split()) for i, t in _texts(df)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens]
    counts = Counter(w for (_, words), out_ in zip(tokens, held) if not out_ for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(words) + 1, sum(counts[w] > 0 for w in [*words, None]), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, None]), 4))
                  for (i, words), h in zip(tokens, held))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert [w[5] for w in want] == pytest.approx([g[5] for g in got], abs=2e-3)


def test_suffix_tree(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = suffix_tree.score(docs).collect()
    check_base(docs, out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    edge = suffix_tree.score(odd).collect()
    check_base(odd, edge)
    assert all(r.score <= 1e-6 for r in edge)
    assert suffix_tree.score(nothing).count() == 0


def test_matrix_rows_become_binary_without_a_copy():
    matrix = np.arange(12, dtype="<u4").reshape(3, 4)
    found = best_fit._as_binary(matrix)
    assert found.to_pylist() == [row.tobytes() for row in matrix]
    assert found.buffers()[2].address == matrix.ctypes.data


def test_suffix_tree_gathers_repeated_contexts_only(spark):
    train = spark.createDataFrame([("a b c d",), ("a b e f",), ("g h i j",)], "text string").select(F.col("text").cast("binary"))
    counts = suffix_tree.word_counts(train).groupBy("word").agg(F.sum("n").alias("c"))
    shared = spark.sparkContext.broadcast(suffix_tree.Bits(counts.where("c >= 2").select(suffix_tree.identity().alias("key"))))
    found = suffix_tree.pairs(train, 1, shared)
    # after the start a and g, after a only b, after b both c and e
    assert sorted(r.n for r in found.collect()) == [1, 1, 1, 2, 2]
    both = found.select("context", "shorter", F.xxhash64("context", "shorter").alias("pair")).toArrow()
    first, second, pair = (both[name].to_numpy().view(np.uint64) for name in both.column_names)
    assert (suffix_tree._hash_longs(first, second) == pair).all()


def test_suffix_tree_leaves_no_working_tables(spark, documents):
    from pathlib import Path

    from siftline.session import shared_folder

    place = Path(shared_folder(spark).removeprefix("file:"))
    before = set(place.iterdir())
    assert suffix_tree.score(documents).count() == documents.count()
    left = [path.name.split("-")[0] for path in place.iterdir() if path not in before and any(path.iterdir())]
    assert sorted(left) == ["model", "model", "model", "scored", "words"]


def test_quality_leaves_no_working_tables(spark, documents):
    from pathlib import Path

    from siftline.session import shared_folder

    place = Path(shared_folder(spark).removeprefix("file:"))
    before = set(place.iterdir())
    few = documents.limit(20)
    assert quality.score(few, few.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")).count() == 20
    assert [path.name.split("-")[0] for path in place.iterdir() if path not in before and any(path.iterdir())] == ["pooled"]


def test_heavy_words_are_only_a_short_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in suffix_tree.score(docs).collect()}
    monkeypatch.setattr(suffix_tree, "HEAVY", 100)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in suffix_tree.score(docs).collect()} == want


def test_contexts_are_longest_and_distributions_add_up():
    random = np.random.default_rng(6)
    symbols = np.r_[0, random.integers(1, 5, 3000), 0].astype(np.int32)
    found = plain_suffix_tree.frequent(symbols, 5, 40, 3)
    tree = plain_suffix_tree.Tree(list(found), 5)
    strings = {tuple(np.frombuffer(s, "<u4").tolist()) for s in found}
    states = tree.states(symbols)
    for at in range(3, 400):
        longest = max((n for n in (1, 2, 3) if tuple(symbols[at - n + 1:at + 1].tolist()) in strings), default=0)
        depth, node = 0, states[at]
        while node:
            node, depth = tree.suffix[node], depth + 1
        assert depth == longest
    counts = np.zeros((tree.nodes, 5), np.float32)
    np.add.at(counts, (states[:-1], symbols[1:]), 1)
    root = np.full(5, 0.2)
    model = plain_suffix_tree.gains(tree, counts, root, 1.0, 2)
    assert np.allclose((10 ** model.astype(float) * root).sum(axis=1), 1, atol=1e-4)


def test_rare_words_are_contexts_whatever_the_size(spark):
    random = np.random.default_rng(8)
    data = [(i, " ".join(f"w{x}" for x in random.integers(0, 50, 2000))) for i in range(200)]
    # each 4 of 400 000 words, far below a share of 1e-4
    late = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    early = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 != 2][:8]
    data += [(i, ("zebra quagga", "okapi ibexes")[k % 2]) for k, i in enumerate(early)]
    data += list(zip(late, ("zebra quagga", "zebra ibexes")))
    df = spark.createDataFrame(data, "doc_id long, text string")
    right, wrong = (r.score - r.base_score for r in suffix_tree.score(df).where(F.col("doc_id").isin(late)).orderBy("doc_id").collect())
    assert right > wrong + 1


def test_tables_hold_the_same_tree_as_the_plain_version(spark, monkeypatch):
    random = np.random.default_rng(9)
    data = [(i, " ".join(f"w{x}" for x in random.zipf(1.5, random.integers(0, 40)) % 60)) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    train = [t.encode().split() for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for words in train for w in [*words, None])
    number = {w: k for k, w in enumerate(sorted(w for w in counts if w), 1)} | {None: 0}
    size = len(number)

    def stream(texts):
        return np.array([0, *(number.get(w, size) for words in texts for w in [*words, None])], np.int32)  # size: not known

    symbols = stream(train)
    tree = plain_suffix_tree.Tree([s for s in plain_suffix_tree.frequent(symbols, size, 2, 3)], size + 1)
    table = np.zeros((tree.nodes, size + 1), np.float32)
    np.add.at(table, (tree.states(symbols)[:-1], symbols[1:]), 1)
    events = sum(counts.values()) + len(counts) + 1
    root = np.array([*((counts[w] + 1) / events for w in sorted(number, key=number.get)), 1 / events])
    gains = plain_suffix_tree.gains(tree, table, root, 16.0, 2)
    assert (gains[1:] != gains[0]).any(axis=1).sum() > 5
    want = {}
    for i, text in data:
        own = stream([text.encode().split()])
        want[i] = float(gains[tree.states(own)[:-1], own[1:]].sum())
    for entries in (suffix_tree.ENTRIES, 8):
        monkeypatch.setattr(suffix_tree, "ENTRIES", entries)
        got = {r.doc_id: r.score - r.base_score for r in suffix_tree.score(df).collect()}
        assert got == pytest.approx(want, abs=2e-3)


def test_suffix_tree_working_tables_stay_small(spark, monkeypatch):
    """All working tables together take less than the text; shuffled rows stay below a few for each token."""
    from pathlib import Path

    random = np.random.default_rng(3)
    data = [(i, " ".join(f"word{x}" for x in random.zipf(1.2, 400) % 5000)) for i in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    size, written = [], suffix_tree.written

    def weighed(table, name):
        out = written(table, name)
        size.append(sum(Path(x.removeprefix("file:")).stat().st_size for x in out.inputFiles()))
        return out

    monkeypatch.setattr(suffix_tree, "written", weighed)
    assert suffix_tree.score(df).count() == 500
    assert sum(size) < sum(len(text) for _, text in data)


def test_suffix_tree_frequent_symbols_are_worked_on_in_pieces(spark, monkeypatch):
    data = [(i, " ".join(("a", f"b{i * j % 7}", "c")[(i + j * j) % 3] for j in range(i % 50))) for i in range(400)]
    df = spark.createDataFrame([*data, (None, None), (3, "a c a c")], "doc_id long, text string").repartition(3)

    def found():
        return sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.score(df).collect())

    want = found()
    assert any(base != score for *_, base, score in want)
    for entries in (100, 1000):  # 1000: words only, 100: the start of texts too
        monkeypatch.setattr(suffix_tree, "ENTRIES", entries)
        assert found() == want


def test_suffix_tree_splits_as_bytes_do():
    texts = [b"  A b\xff\xc3 \x0bc\x1c d\n", None, b"", b" \t\r\x0c ", "ÀÉ x\u00a0y x".encode(), b"x"]
    lengths, numbers, words = suffix_tree._split(pa.array([b"cut off", *texts], pa.binary()).slice(1))
    words = words.to_pylist()
    assert [words[x] for x in numbers] == [word for text in texts for word in (text or b"").lower().split()]
    assert lengths.tolist() == [len((text or b"").split()) for text in texts]


@pytest.mark.parametrize("keys", [[], [5], [5, 5], [8, 9, 8, 1 << 63, 9, 8], np.random.default_rng(2).integers(0, 1 << 63, 1000) % 300 << 40])
def test_groups_are_exact(keys):
    keys = np.array(keys, np.uint64)
    of, first = suffix_tree._groups(keys)
    assert len(first) == len(set(keys.tolist())) and (keys[first][of] == keys).all()


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint32)[1:], np.array([], np.uint64), np.array([True, False]), np.array([-1.5, 2.0])]
    back = suffix_tree._unpacked(suffix_tree._packed(*arrays), *(x.dtype for x in arrays))
    assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(arrays, back))


def test_every_word_has_a_unit_of_its_own():
    words, shapes, lengths = quality.Units().of([" ".join(f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyzäöüßéèàç" for b in "abcdefghijklmnopqrstuvwxyzäöüßéèàç"
                                                          for c in "abcdefghijklmnopqrstuvwxyzäöüßéèàç").split(), []])
    assert lengths.tolist() == [34 ** 3, 0] and len(set(words.tolist())) == 34 ** 3 and len(set(shapes.tolist())) == 1


@pytest.mark.parametrize("other", [quality.Units, lambda: tokenizing.once(dict)])
def test_a_worker_lets_go_of_an_encoder_for_another_operator(other):
    import gc
    import weakref

    gc.disable()
    try:
        kept = weakref.ref(tokenizing.word_encoder(WORDS))
        assert kept() is not None
        other()
        assert kept() is None
    finally:
        gc.enable()


def test_frequent_words_are_worked_on_once(monkeypatch):
    monkeypatch.setattr(quality, "MEMORY", 6)
    asked, plain = [], quality._case
    monkeypatch.setattr(quality, "_case", lambda letters: asked.append(letters) or plain(letters))
    units = quality.Units()
    for k in "abcdef":
        words = ["Often", "Often", *(f"Once{k}{x}" for x in "abcd"), "a,b", "A..", "Often"]
        own, fresh = units.of([words, []]), quality.Units().of([words, []])
        assert all((a == b).all() for a, b in zip(own, fresh))
        assert list(zip(*map(np.ndarray.tolist, own[:2])))[2:6] == [units._both(word) for word in words[2:6]]
    # the six fresh memories ask once each, and so does the one that is kept
    assert asked.count("Often") == 7


def test_frequent_units_are_only_a_short_cut(spark, documents, monkeypatch):
    want = quality.unit_sums(documents.limit(20))
    assert want.agg(F.sum("n")).first()[0] == 2 * sum(len(t.split()) for _, t in _texts(documents.limit(20)))
    for most in (quality.FREQUENT, 50):
        monkeypatch.setattr(quality, "FREQUENT", most)
        rows = sorted(map(tuple, quality.pooled(documents.limit(20), want).collect()))
        if most > 50:
            plain = rows
    assert [r[0] for r in rows] == [r[0] for r in plain] and np.allclose([r[1] for r in rows], [r[1] for r in plain], atol=1e-6)
    assert {len(r[1]) for r in rows} == {2 * quality.DIMENSIONS + 1}


def brute_quality(texts):
    """(sums of contexts by unit, features of each text), word by word."""
    units, where = quality.Units(), []
    for text in texts:
        own = [tuple(units._both(word)) for word in text.split()]
        where.append([(w, quality.Units.REPEATED if k and own[k] == own[k - 1] else s) for k, (w, s) in enumerate(own)])
    vector = {u: quality.index_vectors(np.array([u], np.uint64))[0].astype(int) for pairs in where for pair in pairs for u in pair}
    sums = {}
    for pairs in where:
        for k, pair in enumerate(pairs):
            near = pairs[max(k - quality.WINDOW, 0):k] + pairs[k + 1:k + 1 + quality.WINDOW]
            around = sum((vector[u] for other in near for u in other), np.zeros(quality.DIMENSIONS, int))
            for u in pair:
                n, total = sums.get(u, (0, 0))
                sums[u] = n + 1, total + around

    def unit_vector(u):
        n, total = sums[u]
        mean = total / n
        return mean / max(np.linalg.norm(mean), 1e-9) + vector[u] / np.sqrt(quality.NONZERO)

    features = []
    for pairs in where:
        means = [np.mean([unit_vector(pair[k]) for pair in pairs], axis=0) if pairs else np.zeros(quality.DIMENSIONS) for k in (0, 1)]
        features.append(np.r_[means[0], means[1], np.log1p(len(pairs)) / 10])
    return sums, features


@pytest.mark.parametrize("piece, most", [(1 << 18, 1 << 17), (40, 30)])
def test_context_sums_and_pooling_against_a_plain_loop(spark, monkeypatch, piece, most):
    """Also with texts cut into small pieces, and with most units joined instead of looked up."""
    monkeypatch.setattr(quality, "PIECE", piece)
    monkeypatch.setattr(quality, "FREQUENT", most)
    monkeypatch.setattr(quality, "HELD", 300 if piece < 100 else quality.HELD)
    texts = ["The cat sat. The cat SAT, the the the dog!", "", "one", "a b", "x " * 90 + "end", " \n  odd   spaces \x1c here\u2003now ", "12 34 ** ab-cd Ef" * 9,
             "w" * 200 + " tail of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums, features = brute_quality(texts)
    table = quality.unit_sums(docs)
    got = {r.unit % (1 << 64): (r.n, [r[f"s{k}"] for k in range(quality.DIMENSIONS)]) for r in table.collect()}
    assert got == {u: (n, total.tolist()) for u, (n, total) in sums.items()}
    rows = {r.doc_id: r.features for r in quality.pooled(docs, table).collect()}
    assert all(np.allclose(rows[k], features[k], atol=1e-5) for k in range(len(texts)))


def test_long_pre_tokens_need_no_trie():
    from siftline.llm import token_counts

    counter = token_counts.UnigramCounter(public_tokenizers.path("piece_bpe_32k.model"))
    random = np.random.default_rng(3)
    for n in (1, 7, 200):
        word = "".join(random.choice(list("abcdehinorst-é日"), n))
        assert counter._along(token_counts.MARK + word) == counter._insert(token_counts.MARK + word)
    before = len(counter.children)
    assert counter.tokens("abc" * 100_000) > 1000 and len(counter.children) == before


def test_sums_are_passed_on_in_few_bytes_and_read_again():
    random = np.random.default_rng(11)
    words = [f"{''.join(random.choice(list('abcdefgh'), 6))}" for _ in range(5000)] + ["the"] * 3000
    sums = quality.Sums()
    sums.add([words], np.ones(len(words), bool))
    want = {unit: row.tolist() for unit, row in zip(sums.units.units, sums.sums.of(sums.units).copy()) if row[0]}
    batches = list(sums.passed_on())
    got = {unit % (1 << 64): [n, *row] for b in batches for unit, n, row in
           zip(b.column(0).to_pylist(), b.column(1).to_pylist(), quality._wide(b.column(2)).tolist())}
    assert got == want
    assert sum(b.column(2).buffers()[2].size for b in batches) < 17 * len(want) + 1000
    values = np.array([[0, -7] * 16, [8, -128] * 16, [127, 0] * 16, [-40_000, 3] * 16, [1 << 40, -5] * 16])
    back = {u: row for b in quality._narrow(np.arange(5), np.ones(5, int), values) for u, row in zip(b.column(0).to_pylist(), quality._wide(b.column(2)).tolist())}
    assert [back[k] for k in range(5)] == values.tolist()


def test_units_that_occur_once_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(quality, "FREQUENT", 0)
    tables = {}
    plain = quality.written
    monkeypatch.setattr(quality, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    monkeypatch.setattr(quality, "discard", lambda *_: None)
    texts = ["alpha beta gamma beta delta", "epsilon zeta, gamma!", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, features = brute_quality(texts)
    rows = {r.doc_id: r.features for r in quality.pooled(docs, quality.unit_sums(docs)).collect()}
    assert all(np.allclose(rows[k], features[k], atol=1e-5) for k in range(3))
    asked = {r.doc_id: len(r.words) for r in tables["sums"].collect()}
    assert asked == {0: 3, 1: 1, 2: 0}  # beta twice and gamma; gamma


def test_levels_are_kept_with_what_a_window_changes():
    random = np.random.default_rng(12)
    packer = sum_squares.Packer(64)
    for n in random.integers(1, 65, 300).tolist():
        packer.place((None, 0, np.zeros(n, "<u4")))
        assert packer.into[1:64].tolist() == (2 * packer.levels[1:64]).tolist()
        assert packer.out[1:64].tolist() == [-2 * c if c else sum_squares.NONE for c in packer.levels[1:64].tolist()]
        assert packer.levels[1:].tolist() == [*map(len, packer.windows[1:]), 0] and packer.out[0] == packer.into[64] == -1
    packer.finish()
    assert not packer.levels.any() and not packer.into[:64].any() and (packer.out[1:] == sum_squares.NONE).all()
