"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of a word ends, at every prefix, in one token only, and a sequence of tokens is an encoding
exactly if every two neighbours are: encoded together they stay as they are. So all words of a batch are
relaxed at once, one prefix length after the other: of the tokens that end at a prefix the one that is
compatible with the token before it is taken. Compatibility of two tokens is decided once and remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

START, UNREACHED = -1, -2
#: bits of the table of remembered pairs, and the odd factor that spreads pairs over it
SLOTS, MIX = 20, np.int64(-7046029254386353131)


class Merges:
    """Merge priorities of a vocabulary: ``rank(x, y)`` is the priority (smallest first) or None."""

    def __init__(self, tokens: list[str | None], rank: Callable[[str, str], float | None]):
        self.rank = rank
        self.tokens = tokens
        self.spines = [self._spines(t) if t else None for t in tokens]
        self._keys = np.full(1 << SLOTS, -1, np.int64)
        self._fits = np.zeros(1 << SLOTS, bool)

    def reachable(self, token: int) -> bool:
        return self.spines[token] is not None

    def add(self, token: str) -> int:
        """A symbol outside the vocabulary; it takes part in no merge."""
        self.tokens.append(token)
        self.spines.append(([], []))
        return len(self.tokens) - 1

    def _spines(self, token: str):
        """Merges that change the last and the first symbol of ``token`` as it is built, or None if it is not built."""
        parts = list(token)
        steps: list[tuple[float, str, str]] = []
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best[0]):
                    best = (r, i)
            if best is None:
                return None
            r, i = best
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((r, parts[-1], parts[0]))
        return [(r, last) for r, last, _ in steps], [(r, first) for r, _, first in steps]

    def stays(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when ``a`` and ``b`` are built side by side.

        The better of the next merges is done first; on a tie the one further left.
        """
        left, right = self.spines[a][0], self.spines[b][1]
        x, y, i, j = self.tokens[a][-1], self.tokens[b][0], 0, 0
        while True:
            cross = self.rank(x, y)
            next_a = left[i][0] if i < len(left) else None
            next_b = right[j][0] if j < len(right) else None
            if cross is not None and (next_a is None or cross < next_a) and (next_b is None or cross <= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a <= next_b):
                x, i = left[i][1], i + 1
            else:
                y, j = right[j][1], j + 1

    def compatible(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """``stays`` for arrays of token pairs; answers are kept in a table of fixed size."""
        keys = (before.astype(np.int64) << 32) | after.astype(np.int64)
        slots = (keys * MIX) >> (64 - SLOTS) & ((1 << SLOTS) - 1)
        fits = self._fits[slots]
        open_ = np.flatnonzero(self._keys[slots] != keys)
        if len(open_):
            new, one, back = np.unique(keys[open_], return_index=True, return_inverse=True)
            good = np.fromiter((self.stays(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            fits[open_] = good[back]
            slots = slots[open_][one]
            self._keys[slots], self._fits[slots] = new, good
        return fits


def relax(merges: Merges, lengths: np.ndarray, start: np.ndarray, size: np.ndarray, token: np.ndarray):
    """The last token and the number of tokens at every prefix of every word.

    ``lengths``: symbols in each word, the words standing one after the other. An edge is a token found at
    symbol ``start`` with ``size`` symbols, all inside one word. Node ``start of word + number of word + p``
    is the word's prefix of p symbols. Returns (first node of each word, last token, number of tokens).
    """
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(lengths)), lengths)[start]
    first = ends - lengths + np.arange(len(lengths))
    begin = start + word
    target = begin + size
    prefix = target - first[word]
    if len(prefix) and int(prefix.max()) < 1 << 16:
        prefix = prefix.astype(np.uint16)  # sorted by radix
    order = np.argsort(prefix, kind="stable")
    begin, target, token, prefix = begin[order], target[order], token[order], prefix[order]
    last = np.full(int(lengths.sum()) + len(lengths), UNREACHED, np.int64)
    count = np.zeros(len(last), np.int32)
    last[first] = START
    cuts = np.flatnonzero(np.diff(prefix)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(prefix)], strict=True):
        b, t, k = begin[lo:hi], target[lo:hi], token[lo:hi]
        before = last[b]
        good = before == START
        ask = np.flatnonzero(before >= 0)
        if len(ask):
            good[ask] = merges.compatible(before[ask], k[ask])
        t, b, k = t[good], b[good], k[good]
        last[t] = k
        count[t] = count[b] + 1
    return first, last, count
