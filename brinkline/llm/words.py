"""Hashed words of a text, for the operators that compare word sequences."""

from __future__ import annotations

import secrets

import numpy as np
import xxhash

U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHash(dict):
    """Hashes of words, remembered up to a bound of about 20 MB."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 32:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


SEGMENT = 1 << 20
SHORT = 64
BASE = 0x5851F42D4C957F2D


def drawn_base() -> int:
    """A base of the polynomial hash that nobody knows before the job; 5 modulo 8, so its powers do not soon repeat."""
    return secrets.randbits(64) & ~7 | 5


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    np.multiply.accumulate(np.full(n - 1, base, U), out=out[1:])
    return out


class Powers:
    """Powers of the base of the polynomial hash and of its inverse, made as they are needed; those of one base are kept."""

    base, up, down = BASE, _powers(BASE, 1 << 14), _powers(pow(BASE, -1, 1 << 64), 1 << 14)

    @classmethod
    def upto(cls, n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n or cls.base != base:
            size = max(n, 2 * len(cls.up) if cls.base == base else 1 << 14)
            cls.base, cls.up, cls.down = base, _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        return cls.up[:n], cls.down[:n]


def hashed_words(text: str | None, base: int = BASE) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as 64-bit hashes.

    A word of up to ``SHORT`` bytes has as hash its polynomial in the base
    modulo 2**64, taken from running sums over the whole text; long texts are
    cut at blanks.  Longer words are hashed one by one (XXH3).  For a known
    base, words with one hash are easily made, so jobs that trust it draw
    their own (:func:`drawn_base`): two given words then share a hash with a
    chance of some 2**-64, or, if they were made to do so in as many bases as
    64 bytes allow, of some 2**-37.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            blank = np.flatnonzero(SPACES[data[at:end]])
            while not len(blank) and end < len(data):  # one word longer than a segment
                end += SEGMENT
                blank = np.flatnonzero(SPACES[data[at:end]])
            end = at + int(blank[-1]) + 1 if len(blank) and end < len(data) else len(data)
        out.append(_segment(data[at:end], base))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, U)


def _segment(data: np.ndarray, base: int) -> np.ndarray:
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = SPACES[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = Powers.upto(len(data) + 1, base)
    run = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=run[1:])
    out = mix((run[end] - run[start]) * down[start] + (end - start).astype(U))
    for i in np.flatnonzero(end - start > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    total = np.zeros(n - width + 1, U)
    for k in range(width):
        total = (total ^ (words[k : n - width + 1 + k] * ODD[k % 4])) * ODD[(k + 1) % 4] + U(k + 1)
    return np.unique(mix(total + U(width)))
