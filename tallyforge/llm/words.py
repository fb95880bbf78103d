"""Word sequences as 64-bit hashes, and rolling hashes over them, for whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits, so that any of them can be compared or taken."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a text that are hashed at a time, cut at white space; a longer word stays whole.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _LETTER.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]


class WordHasher:
    """Hashes of the words between white-space bytes (or those in ``gap``) of a UTF-8 text, A-Z as a-z where ``fold`` is set.

    A word's hash is the polynomial of its bytes, each as a random number; those of a whole piece, and of any part of a word, come from one running
    sum, as the power where a word starts can be divided out again modulo 2^64.
    """

    def __init__(self, fold: bool = True, gap: np.ndarray = _IS_GAP):
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self.letter = _FOLDED if fold else _LETTER
        self.gap = gap

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(2 * n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The running sums of a piece, and where its words start and end."""
        b = np.frombuffer(data, dtype=np.uint8)
        self._grow(len(b) + 1)
        gap = np.ones(len(b) + 2, dtype=bool)
        gap[1:-1] = self.gap[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self.letter[b] * self.power[: len(b)], out=sums[1:])
        return sums, edge[::2], edge[1::2]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def located(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and the byte that each begins at."""
        parts = []
        for at, piece in pieces(data):
            sums, start, end = self.spans(piece)
            parts.append((self.of(sums, start, end), start + at))
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))

    def __call__(self, data: bytes) -> np.ndarray:
        return self.located(data)[0]


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The text in pieces of about PIECE bytes, cut at white space, each with the byte it begins at."""
    at = 0
    while len(data) - at > PIECE and (cut := _GAP.search(data, at + PIECE)):
        yield at, data[at : cut.start()]
        at = cut.end()
    yield at, data[at:]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k values in a row, by doubling."""
    out, length, power = None, 0, 0
    part, size, factor = h, 1, BASE
    while k >> power:
        if k >> power & 1:
            if out is None:
                out, length = part, size
            else:
                n = min(len(out), len(part) - length) if len(part) > length else 0
                out = out[:n] * np.uint64(factor) + part[length : length + n]
                length += size
        power += 1
        if k >> power:
            n = max(len(part) - size, 0)
            part = part[:n] * np.uint64(factor) + part[size : size + n]
            size *= 2
            factor = factor * factor % (1 << 64)
    return mix(out)
