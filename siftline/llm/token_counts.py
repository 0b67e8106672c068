"""Token counts by a unigram model, computed once per shared prefix in a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .tokenizing import once

#: The mark of a word's beginning in vocabularies of this kind.
MARK = "▁"
#: Nodes of the trie a worker keeps; it starts anew beyond, which changes no count.
NODES = 1_000_000
LONG = 256  # characters of a pre-token that the trie takes


class UnigramCounter:
    """The most probable segmentation of every pre-token, as a number of tokens.

    The file orders its pieces by rank; a piece's log probability is that of Zipf's law at its rank, as the file
    holds none. A character that no piece covers costs its UTF-8 bytes, one token each, and more than any piece.
    A node of the trie is a prefix: ``score`` is the forward score of its best segmentation, ``count`` that segmentation's
    tokens (the fewest, if several are best). Both depend on the prefix alone, so words share them.
    """

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        usable = [model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # the scores of the file only give the order
        total = math.log(sum(1 / rank for rank in range(1, len(usable) + 1)))
        self.pieces = {piece: -math.log(rank) - total for rank, piece in enumerate(usable, 1)}
        self.longest = max(map(len, self.pieces))
        self.byte = min(self.pieces.values()) - 10.0
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}  # tokens of each distinct pre-token met

    def tokens(self, word: str) -> int:
        """Tokens of one pre-token. A long one, which shares little more than its start with others, isn't put into the trie."""
        if len(word) > LONG:
            return self._along(MARK + word)
        known = self.terminal.get(word)
        if known is None:
            if len(self.children) > NODES or len(self.terminal) > NODES:
                self._clear()
            known = self.terminal[word] = self._insert(MARK + word)
        return known

    def _insert(self, text: str) -> int:
        children, path, node = self.children, [0], 0
        for at, character in enumerate(text):
            following = children[node].get(character)
            if following is None:
                following = len(children)
                children[node][character] = following
                children.append({})
                self._extend(text, at + 1, path)
            node = following
            path.append(node)
        return self.count[node]

    def _along(self, text: str) -> int:
        """The same scores for one text alone: a prefix needs those of the prefixes shorter by up to the longest piece, and only these are kept."""
        window, get = self.longest, self.pieces.get
        score, count = [0.0] * window, [0] * window  # of the prefix that ends at a place, by its rest modulo the window
        for end in range(1, len(text) + 1):
            last, n = (end - 1) % window, len(text[end - 1].encode("utf-8", "surrogatepass"))
            best, fewest = score[last] + n * self.byte, count[last] + n
            for start in range(max(0, end - window), end):
                own = get(text[start:end])
                if own is not None:
                    total, tokens = score[start % window] + own, count[start % window] + 1
                    if total > best or total == best and tokens < fewest:
                        best, fewest = total, tokens
            score[end % window], count[end % window] = best, fewest
        return count[len(text) % window]

    def _extend(self, text: str, end: int, path: list[int]) -> None:
        """Forward score of the prefix that ends at ``end`` from those of the shorter ones on ``path``."""
        score, count, get = self.score, self.count, self.pieces.get
        last = path[end - 1]
        n = len(text[end - 1].encode())
        best, fewest = score[last] + n * self.byte, count[last] + n
        for start in range(max(0, end - self.longest), end):
            own = get(text[start:end])
            if own is not None:
                total, tokens = score[path[start]] + own, count[path[start]] + 1
                if total > best or total == best and tokens < fewest:
                    best, fewest = total, tokens
        score.append(best)
        count.append(fewest)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs``.

    Pre-tokens are what lies between white space. A null, empty or blank text counts 0. Distinct pre-tokens are kept
    by each worker in a trie of bounded size, which is emptied when it is full; those of over ``LONG`` characters are scored
    along their length in constant memory. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(UnigramCounter, vocabulary)
        for batch in batches:
            words, tokens = [], []
            for x in batch.column(1).to_pylist():
                own = (x or "").split()
                words.append(len(own))
                tokens.append(sum(map(counter.tokens, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["doc_id", "n_words", "n_tokens"])

    narrow = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
