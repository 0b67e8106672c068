"""The suffix tree as a plain version for one machine, which the tests hold the tables against."""

from __future__ import annotations

import numpy as np

from siftline.llm.suffix_tree import END


class Tree:
    """The plain version, for one machine: all contexts that may matter, as a table ``child[node, symbol]`` (0: none); node 0 is the empty context.

    A node is the string of symbols read from it, oldest first. The set holds every part of each of its strings, so the
    longest one that ends at a place is found by extending, symbol by symbol, the strings that end one place before.
    """

    def __init__(self, contexts: list[bytes], symbols: int):
        """``contexts``: four bytes for each symbol."""
        strings = sorted({tuple(np.frombuffer(c, "<u4").tolist()) for c in contexts}, key=lambda s: (len(s), s))
        number = {(): 0}
        for string in strings:
            if string[:-1] in number and string[1:] in number:
                number[string] = len(number)
        self.nodes, self.symbols = len(number), symbols
        self.depth = max(map(len, number))
        self.child = np.zeros((self.nodes, symbols), np.int32)
        self.suffix = np.zeros(self.nodes, np.int32)
        for string, node in number.items():
            if string:
                self.child[number[string[:-1]], string[-1]] = node
                self.suffix[node] = number[string[1:]]

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The node of the longest context that ends at each place, no context reaching back over an END."""
        longest = level = self.child[0, symbols]
        begins = symbols == END
        for _ in range(1, self.depth):
            level = np.concatenate([[0], self.child[level[:-1], symbols[1:]] * (level[:-1] > 0)])
            level[begins] = 0
            longest = np.where(level > 0, level, longest)
        return longest


def frequent(symbols: np.ndarray, size: int, least: float, depth: int) -> dict[bytes, int]:
    """Strings of up to ``depth`` symbols that occur ``least`` times or more in a stream, none reaching over an END."""
    found: dict[bytes, int] = {}
    begins = symbols == END
    strings = [b""]
    level = np.zeros(len(symbols) + 1, np.int64)  # dense number of the string that ends before each place
    for length in range(1, depth + 1):
        code = np.where(level[:-1] >= 0, level[:-1] * size + symbols, -1)
        if length > 1:
            code[begins] = -1
        counts = np.bincount(code[code >= 0], minlength=len(strings) * size)
        kept = np.flatnonzero(counts >= least)
        if not len(kept):
            break
        strings = [strings[c // size] + int(c % size).to_bytes(4, "little") for c in kept.tolist()]
        found.update(zip(strings, counts[kept].tolist()))
        number = np.full(len(counts), -1, np.int64)
        number[kept] = np.arange(len(kept))
        level = np.concatenate([[-1], np.where(code >= 0, number[code], -1)])
    return found


def gains(tree: Tree, counts: np.ndarray, root: np.ndarray, gain: float, least: float) -> np.ndarray:
    """log10 of how much likelier each symbol is at each node than at the root, float32.

    ``counts`` of longest contexts become those of all contexts by adding them to their suffixes. A context is kept if it
    occurs ``least`` times and its symbols diverge from those of the context one symbol shorter: count x
    Kullback-Leibler divergence of at least ``gain`` bits. Its distribution is smoothed by that one (Witten-Bell), the root's is
    given. A context not kept has the distribution of its longest kept suffix.
    """
    for node in range(len(counts) - 1, 0, -1):  # longer ones have greater numbers
        counts[tree.suffix[node]] += counts[node]
    p = np.empty(counts.shape, np.float32)
    p[0] = root
    for node in range(1, len(counts)):
        shorter, own = p[tree.suffix[node]].astype(float), counts[node].astype(float)
        n, kinds = own.sum(), np.count_nonzero(own)
        p[node] = shorter
        if n >= least:
            own = (own + kinds * shorter) / (n + kinds)
            if n * np.sum(own * np.log2(own / shorter)) >= gain:
                p[node] = own
    return np.log10(p / root.astype(np.float32))
