"""Vectorised text primitives shared by the Arrow-batched operators.

A batch of texts becomes one array of code points. Words are maximal runs of characters that are
alphanumeric or ``_``, lower-cased one character at a time; hashes of words come from one prefix
sum of a polynomial modulo 2**64, so no Python code runs for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_CHARS = 400_000


@cache
def word_table() -> np.ndarray:
    """1 for code points that belong to words."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), np.bool_, 0x110000)


@cache
def alpha_table() -> np.ndarray:
    return np.fromiter((c.isalpha() for c in map(chr, range(0x110000))), np.bool_, 0x110000)


@cache
def lower_table() -> np.ndarray:
    """Lower case of each code point, itself where that isn't one character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system after a batch: a worker lives on, idle, beside the next stages."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def lower_char_text(text: str) -> str:
    """The lower-casing that :func:`lower_table` applies, for brute-force versions."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 19)
        for key, base in (("p", BASE), ("q", BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text starts (one more entry than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` characters together (a longer text comes alone); None counts as empty."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > most:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run


class Words:
    """Words of some texts: ``start``, ``end`` (positions in all code points), ``hash``, ``first``
    (index of each text's first word; one more entry than texts)."""

    def __init__(self, texts: list[str]):
        self.cp, self.at = code_points(texts)
        n = len(self.cp)
        inside = np.zeros(n + 2, np.bool_)
        inside[1:-1] = word_table()[self.cp]
        edge = inside[1:] != inside[:-1]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        starts = np.flatnonzero(edge[:-1] & inside[1:-1]) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(edge & inside[:-1])
        if len(joined):
            joined = np.unique(joined)
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
        self.start, self.end = starts, ends
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum((lower_table()[self.cp].astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
        self.hash = mix((sums[ends] - sums[starts]) * q[starts])
        self._sums = sums
        self.first = np.searchsorted(starts, self.at)

    def beginnings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of more than k characters, and hashes of their first k."""
        at = np.flatnonzero(self.end - self.start > k)
        begin = self.start[at]
        _, q = powers(len(self.cp) + 1)
        return at, mix((self._sums[begin + k] - self._sums[begin]) * q[begin] + np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words of each text, and each text's first (one more entry than
        texts). A text of 1 to k-1 words has one shingle, all of it; without words it has none."""
        h, first = self.hash, self.first
        counts = np.diff(first)
        out = np.zeros(len(h), np.uint64)
        for j in range(k):
            out[: len(h) - j] += h[j:] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        keep = np.ones(len(h), np.bool_)
        ends = first[1:][counts > 0]
        for j in range(1, k):
            back = ends - j
            keep[back[back >= first[:-1][counts > 0]]] = False
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            a, b = first[i], first[i + 1]
            keep[a] = True
            out[a] = sum(int(x) * pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j, x in enumerate(h[a:b])) % (1 << 64)
        kept = np.concatenate([[0], np.cumsum(keep)])
        return mix(out[keep]), kept[first]
