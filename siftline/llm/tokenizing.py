"""Whole texts to token ids with the ``tokenizers`` library, each distinct piece of text encoded once per worker.

A text is cut where no token can cross, its pieces are looked up, and only new pieces go to the library, many in one
call. Ids are exactly those of encoding each text in one go.
"""

from __future__ import annotations

import base64
import gc
import os
import re
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import regex
from tokenizers import Tokenizer, models, pre_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered per worker in each of two generations; the older one goes when the younger is full.
MEMORY = 200_000

_loaded: dict[tuple, object] = {}


def once(make: Callable, *key):
    """``make(*key)``, kept by the worker until something else is asked for: a worker that goes on to another operator lets go of the last one's."""
    if (make, key) not in _loaded:
        let_go()
        _loaded[make, key] = make(*key)
    return _loaded[make, key]


def let_go() -> None:
    """Let go of what ``once`` keeps, also for an operator that keeps nothing there but has much of its own."""
    if _loaded:
        _loaded.clear()
        gc.collect()  # an encoder and its memory refer to each other


class Memo:
    """Bounded memory of what each piece is encoded to (bytes of little-endian unsigned 32-bit ids)."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = MEMORY):
        self.encode, self.size = encode, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """A dictionary that has all of ``pieces``."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        missing = pieces.difference(self.young)
        new = list(missing.difference(self.old))
        self.young.update([(piece, self.old[piece]) for piece in missing.difference(new)])
        if new:
            self.young.update(zip(new, self.encode(new)))
        return self.young


class TextEncoder:
    """``cut`` splits a text into pieces that are encoded separately."""

    cut: Callable[[str], list[str]]
    memo: Memo

    def encode(self, texts: Iterable[str]) -> Iterable[bytes]:
        """Ids of each text as bytes; texts are taken up to a bounded number of characters at a time."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.cut(text))
            size += len(text)
            if size > 1 << 19:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterable[bytes]:
        known = self.memo.learn(set().union(*group))
        for pieces in group:
            yield b"".join(map(known.__getitem__, pieces))


def _packed(ids) -> np.ndarray:
    return np.asarray(ids, "<u4")


#: Characters that never join a letter before them in one pre-token, at the end of a piece: letters that stay one when they become small.
APART = re.compile(r"(?m)[.,!?;:*#$%&](?<=[A-Za-zÀ-ÖØ-öø-įı-ſа-яА-Я].)[.,!?;:*#$%&]*$")
#: A pre-token of its own with one id, put between words that are encoded in one call.
FENCE = "~"
#: Words of small letters that are one character each, and one of each letter.
SMALL = re.compile("[a-zß-öø-ÿ]+")
PROBE = "the quick brown fox jumps over the lazy dog " + " ".join("ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ") + " àéîõü"
#: Words of one text for the library; it takes longer for each word of a long text.
GROUP = 200


class WordEncoder(TextEncoder):
    """A tokenizer file that drops white space and marks the ends of words, such as word_bpe_49k.json."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fence = self._whole(FENCE)
        # a word of small letters is one pre-token as it is, so white space alone tells such words apart; where a file has it otherwise, it is used itself
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.plain.encode(PROBE, add_special_tokens=False).ids != self._whole(PROBE):
            self.plain = self.tokenizer
        self.memo = Memo(self._pieces, 2 * MEMORY)
        self.words = Memo(self._words, 2 * MEMORY)

    @staticmethod
    def cut(text: str) -> list[str]:
        # white space is dropped and no token crosses it; other kinds of it stay inside the pieces. The tokenizer makes all letters small
        if text.isascii():
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """A letter and a following ending never share a token, so both sides are looked up apart."""
        # no piece has a line or a space in it; the tokenizer makes all letters small
        parts = APART.sub(r" \g<0>", "\n".join([piece.lower() if piece.isascii() else piece for piece in pieces]))
        known = self.words.learn(set(parts.replace("\n", " ").split(" ")))
        return [b"".join(map(known.__getitem__, part.split(" "))) for part in parts.split("\n")]

    def _words(self, words: list[str]) -> list[bytes]:
        found = dict.fromkeys(words, b"")
        small = list(filter(SMALL.fullmatch, words))
        others = [word for word in set(words).difference(small) if word and FENCE not in word]
        for tokenizer, own in ((self.plain, small), (self.tokenizer, others)):
            groups = [own[at:at + GROUP] for at in range(0, len(own), GROUP)]
            encoded = tokenizer.encode_batch_fast([f" {FENCE} ".join(group) for group in groups], add_special_tokens=False)
            for group, encoding in zip(groups, encoded):
                ids = _packed(encoding.ids)
                at = np.flatnonzero(ids == self.fence[0]) if len(self.fence) == 1 else np.empty(0, int)
                if len(at) == len(group) - 1:
                    data, edges = ids.tobytes(), (4 * at).tolist()
                    found.update((word, data[a:b]) for word, a, b in zip(group, [0, *(x + 4 for x in edges)], [*edges, len(data)]))
                else:  # a fence that came out of something else: one by one
                    found.update((word, _packed(self._whole(word)).tobytes()) for word in group)
        found.update((word, _packed(self._whole(word)).tobytes()) for word in words if FENCE in word)
        return [found[word] for word in words]


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is
    printable in Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteEncoder(TextEncoder):
    """Byte-level BPE by a file of ranks; each match of ``pattern`` is encoded separately.

    Every split of a token into two tokens is a merge, in the order of ranks, and a match that is a token is
    taken whole: the pair with the smallest rank is merged first, as by the ranks themselves.
    """

    #: White space before a space that more white space or the end follows: there a run of it may be one match.
    RUNS = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.path, self.character = path, byte_characters()
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.width = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.pattern = regex.compile(pattern)
        self.memo = Memo(self._pieces)
        self.matches = Memo(self._matches)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """Only encoding needs it."""
        ranks = read_ranks(self.path)
        merges = [(self._mapped(token[:i]), self._mapped(token[i:]))
                  for token, _ in sorted(ranks.items(), key=lambda x: x[1])
                  for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        vocab = {self._mapped(token): rank for token, rank in ranks.items()}
        tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Split(" ", "removed")  # a space is no mapped character
        return tokenizer

    def _mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.character)

    def cut(self, text: str) -> list[str]:
        # a match that holds a space begins with it, except in a run of white space
        if "\0" in text or self.RUNS.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self.pattern.findall(piece) for piece in pieces]
        known = self.matches.learn(set().union(*split))
        return [b"".join(map(known.__getitem__, matches)) for matches in split]

    def _matches(self, matches: list[str]) -> list[bytes]:
        mapped = [self._mapped(match.encode()) for match in matches]
        ids = _packed(self.tokenizer.encode(" ".join(mapped), add_special_tokens=False).ids)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(x) for x in mapped])) + 1
        edges = [0, *ends.tolist()]
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; a token with part of a character covers it."""
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.width[ids])
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        return character[ends - self.width[ids]], character[ends - 1] + 1


def word_encoder(path: str) -> WordEncoder:
    return once(WordEncoder, path)


def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    return once(ByteEncoder, path, pattern)
