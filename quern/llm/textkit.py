"""Vectorised text primitives for Arrow batches.

Texts of a batch are laid end to end as one array of code points; words,
word hashes and hashes of word sequences come from prefix sums of a polynomial
modulo 2**64, so no Python loop runs per character or per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
_QINV = np.uint64(pow(int(_Q), -1, 1 << 64))

#: Code points handled at a time; bounds a worker's memory whatever the batch.
CHUNK_CHARS = 400_000


def slices(lengths: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` characters."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the n + 1 offsets of the texts in them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), offsets


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(which: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _cached_powers(which, size)[:n]


@lru_cache(maxsize=16)
def _cached_powers(which: int, size: int) -> np.ndarray:
    return _powers((_P, _PINV, _Q, _QINV)[which], size)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of ``values[start:end]`` for every range, equal for equal content.

    ``second`` picks the other base, for hashing sequences of hashes.
    """
    b = 2 if second else 0
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(b, len(values)), dtype=np.uint64, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(b + 1, len(values) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """Per code point its lower-case form, or 0 where it is no letter or digit."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    out = np.zeros(0x10000, bool)
    for c in range(0x10000):
        out[c] = chr(c).isspace()
    return out


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of true values, cut at texts' ends."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def folded_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters or digits, and each one's text."""
    cps, offsets = code_points(texts)
    low = word_table()[cps]
    start, end, doc = _runs(low != 0, offsets)
    return range_hashes(low, start, end), doc


def spaced_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end (within the text) of white-space pieces."""
    cps, offsets = code_points(texts)
    blank = space_table()[np.minimum(cps, 0xFFFF)]
    start, end, doc = _runs(~blank, offsets)
    base = offsets[doc]
    return range_hashes(cps, start, end), doc, start - base, end - base


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position within one text, and the position."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    return range_hashes(words, at, at + k, second=True), at


def distinct_grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word hashes (52 bits) of every text: hashes and text numbers."""
    words, doc = folded_words(texts)
    h, at = grams(words, doc, k)
    h = h >> np.uint64(12)
    d = doc[at].astype(np.uint64)
    out = []
    # text number and hash are sorted as one number, 4096 texts at a time
    for a, z in zip(*(np.searchsorted(d, np.arange(0, len(texts), 4096, dtype=np.uint64) + np.uint64(s)) for s in (0, 4096))):
        both = (d[a:z] % np.uint64(4096)) << np.uint64(52) | h[a:z]
        both.sort()
        keep = np.ones(len(both), bool)
        keep[1:] = both[1:] != both[:-1]
        both = both[keep]
        out.append((both & np.uint64((1 << 52) - 1), (both >> np.uint64(52)).astype(np.int64) + 4096 * len(out)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in out]), np.concatenate([d for _, d in out])
