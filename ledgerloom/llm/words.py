"""Words of whole batches of texts as arrays: places, hashes and texts, without a Python step for each word.

A word is a longest run of digits, letters A-Z in either case and bytes from 0x80 on (all of UTF-8 beyond ASCII); only A-Z
are lower-cased. A word's hash is a polynomial in its bytes with an odd base modulo 2^64, mixed with its length: equal
words have equal hashes, and whoever needs certainty compares the words themselves.
"""

from __future__ import annotations

import numpy as np

from .common import arrow_bytes, pieces

_U = np.uint64
BASE, BASE_WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that are looked at together (a longer text is looked at by itself).
SLICE = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=_U)
    return _POWERS[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words:
    """The words of some texts: `text` is each word's text, `start` and `end` its place in `data` (lower-cased bytes)."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.n_texts, self.data = len(texts), _LOWER[raw]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = _IN_WORD[raw]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.text = np.searchsorted(self.ends, self.start, "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # of each text, and the end of all

    def hashes(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * powers(BASE, len(self.data)), out=sums[1:])
        own = (sums[self.end] - sums[self.start]) * powers(INVERSE, len(self.data))[self.start]
        return mixed(own + (self.end - self.start).astype(_U) * _U(BASE_WORDS))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j - 1 with one space between."""
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist())])


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k hashed words in a row, from each word that k - 1 others follow."""
    if len(words) < k:
        return np.empty(0, _U)
    found = np.zeros(len(words) - k + 1, _U)
    for j in range(k):
        found += words[j : len(words) - k + 1 + j] * _U(pow(BASE_WORDS, j + 1, 1 << 64))
    return mixed(found)


def text_slices(batches, column: int = 1):
    """(slice of a record batch, its texts as Words)."""
    for batch in batches:
        for part in pieces(batch, SLICE):
            yield part, Words(arrow_bytes(part.column(column)))
