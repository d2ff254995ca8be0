"""Digests of word sequences, many texts at once.

Texts are joined by single blanks word by word, so equal word sequences are equal bytes.
A running polynomial over the bytes, modulo 2 to the 64, gives the digest of any range in
two array look-ups; a mixer spreads it over all bits.  Digests depend on nothing but the
words: the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# a fixed table by byte, of the mixer below
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(256, dtype=np.uint64), 7)


def normal(text: str | None, lower: bool = False) -> bytes:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, joined by one blank; null: no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return b" ".join((raw.translate(_LOWER) if lower else raw).split())


class Words:
    """Words of some normal texts: where they start and end, and whose they are."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n_texts = len(texts)
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        n = len(raw)
        powers = _powers(n + 1)
        self._inverse = _powers(n + 1, _INVERSE)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[raw] * powers[:n], out=self._sums[1:])
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [n]])
        text = np.zeros(len(start), np.int64)
        np.cumsum(raw[gaps] == 10, out=text[1:])
        there = end > start  # an empty text leaves an empty word
        self.start, self.end, self.text = start[there], end[there], text[there]
        #: words of each text, and the number of its first word
        self.count = np.bincount(self.text, minlength=self.n_texts)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if self.n_texts else np.zeros(0, np.int64)

    def digest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digests of the word sequences from ``first`` to ``last``, both included."""
        a, b = self.start[first], self.end[last]
        return mix((self._sums[b] - self._sums[a]) * self._inverse[a])

    def windows(self, k: int) -> np.ndarray:
        """Numbers of the words at which ``k`` words of one text start."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :])


_TABLES: dict[int, np.ndarray] = {}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0, 1, ... as 64-bit numbers; kept and grown by doubling."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            table[done : 2 * done] = table[:done] * step
            done *= 2
        _TABLES[base] = table
    return table[:n]


def in_slices(texts: list[bytes], size: int = 250_000) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of about ``size`` bytes, at least one text each.

    Digests of a slice and its windows take some 100 bytes per byte of text.
    """
    first, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield first, texts[first : n + 1]
            first, held = n + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the ``k``-word windows of each text, sorted, and whose they are.

    A text with fewer words, but some, has one shingle: all its words.
    """
    at = words.windows(k)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    digests = np.concatenate([words.digest(at, at + k - 1), words.digest(words.first[few], words.first[few] + words.count[few] - 1)])
    owner = np.concatenate([words.text[at], few])
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    new = np.ones(len(digests), bool)
    new[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
    return digests[new], owner[new]
